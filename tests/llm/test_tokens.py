import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from regionflow.llm import packing as K
from regionflow.llm import pieces as P
from regionflow.llm import token_counts as C
from tokenizers import Tokenizer

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY, SP = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
ODD = st.lists(st.sampled_from(list("aab  \n\t\x0b\x1c\x85 'st.!12²Ⅷé中😀ํ▁") + ["<|endoftext|>", "'ll", " the", "ing"]), max_size=60).map("".join)


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_as_the_libraries(text):
    assert list(C.counter(JSON)([text])) == [len(ids(text))]
    assert np.frombuffer(next(K.encoder(JSON)([text])), "<u4").tolist() == ids(text)
    got = next(P.encoder(MODEL)([text]))
    assert np.frombuffer(got, "<u4").tolist() == SP.encode(text)
    if "▁" not in text:
        assert P.text_of(np.frombuffer(got, "<u4").tolist(), P.piece_bytes(MODEL)) == text


def test_long_texts():
    for text in ("a" * 30_000, " " * 5_000, "word  next\n\n more " * 90_000, "ab" * 4_000 + " " + "<|endoftext|>" * 50):
        assert list(C.counter(JSON)([text])) == [len(ids(text))]
        assert np.frombuffer(next(K.encoder(JSON)([text])), "<u4").tolist() == ids(text)


def used_matrices(monkeypatch):
    steps = []
    whole = P.settle_path
    monkeypatch.setattr(P, "settle_path", lambda s: steps.extend(s) or whole(s))
    return steps


def test_giant_documents_in_chunks(corpus, monkeypatch):
    """Ordinary texts of 100,000 characters go through transfer matrices, wherever the cuts fall."""
    steps = used_matrices(monkeypatch)
    text = " ".join(r["text"] for r in corpus.where("text is not null").limit(60).collect())[:100_000]
    assert len(text) == 100_000
    for chunk in (P.CHUNK, 997, 61):
        steps.clear()
        assert np.frombuffer(next(P.encoder(MODEL)([text], chunk)), "<u4").tolist() == SP.encode(text)
        assert len(steps) in (len(text) // chunk, len(text) // chunk + 1) and max(len(s) for s in steps) > 3  # cuts inside words have several states


def test_stretches_without_a_word_in_chunks():
    rng = random.Random(2)
    for n, chunk in ((200, 17), (2_000, 64), (2_000, 301)):
        text = "".join(rng.choice(["the", "ing", "a", "b", "er", "ou", "é", "中", "x"]) for _ in range(n))
        assert np.frombuffer(next(P.encoder(MODEL)([text], chunk)), "<u4").tolist() == SP.encode(text)


@settings(max_examples=200, deadline=None)
@given(ODD, st.integers(17, 40))
def test_any_chunk_gives_the_same(text, chunk):
    assert np.frombuffer(next(P.encoder(MODEL)([text], chunk)), "<u4").tolist() == SP.encode(text)


def test_neighbours_are_what_merges_leave_alone():
    lattice, rng = P.encoder(MODEL).lattice, random.Random(3)
    some = rng.sample(sorted(s for s in lattice.numbers if len(s) > 1), 300)
    for a, b in zip(some, some[1:], strict=False):
        assert lattice.neighbours(lattice.numbers[a], lattice.numbers[b]) == (lattice.merged(a + b) == [a, b])


def test_other_models_are_refused(tmp_path):
    data = open(MODEL, "rb").read()
    assert P.checked(MODEL) == MODEL
    for trainer, normalizer in ((b"\x18\x01", b""), (b"", b"\x12\x03abc"), (b"", b"\x18\x00"), (b"", b"\x20\x01")):  # unigram, a charsmap, no mark in front, spaces removed
        (tmp_path / "m").write_bytes(data)
        model = P.fields(data)
        out = b"".join(b"\x12" + varint(len(x)) + x for x in [model[2][0] + trainer]) + b"".join(b"\x1a" + varint(len(x)) + x for x in [model[3][0] + normalizer])
        (tmp_path / "m").write_bytes(b"".join(b"\x0a" + varint(len(x)) + x for x in model[1]) + out)
        with pytest.raises(ValueError):
            P.checked(str(tmp_path / "m"))


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def test_counts(docs, nothing):
    got = {}
    for r in C.count_tokens(docs, JSON).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_tokens"], r["over_limit"]))
    for r in docs.collect():
        t = r["text"] or ""
        assert (len(t.encode()), len(ids(t)), len(ids(t)) > 1024) in got[r["doc_id"]]
    assert sum(map(len, got.values())) == docs.count() and C.count_tokens(nothing, JSON).count() == 0


def test_packing(docs, corpus, nothing):
    for df in (docs, corpus):
        rows = K.pack(df, JSON).collect()
        texts = {}
        for r in df.collect():
            texts.setdefault(r["doc_id"], []).append(r["text"] or "")
        bins, seen = {}, {}
        for r in rows:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            seen.setdefault(r["doc_id"], []).append(r)
        for spans in bins.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 1024
        for doc_id, parts in seen.items():
            total = sum(len(ids(t)) + 1 for t in texts[doc_id])
            assert sum(r["length"] for r in parts) == total
            if len(texts[doc_id]) > 1:
                continue
            whole, at = np.array([*ids(texts[doc_id][0]), 2], "<u4"), 0
            for k, r in enumerate(sorted(parts, key=lambda r: r["piece"])):
                assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 1024)
                assert r["ids_crc32"] == zlib.crc32(whole[at : at + r["length"]].tobytes())
                at += r["length"]
        least = -(-sum(r["length"] for r in rows) // 1024)
        assert len(bins) <= least + 2 and set(seen) == set(texts)
    assert K.pack(nothing, JSON).count() == 0


def fewest(items, capacity):
    """By trying everything."""
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        tried = set()
        for i, b in enumerate(bins):
            if b + items[k] <= capacity and b not in tried:
                tried.add(b)
                go(k + 1, [*bins[:i], b + items[k], *bins[i + 1 :]])
        go(k + 1, [*bins, items[k]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_an_optimum(items):
    hist = np.bincount(items, minlength=21)
    fixed, rest = K.reduce(hist)
    left = [s for s in range(21) for _ in range(int(rest[s]))]
    assert sum(n for _, n in fixed) + (fewest(left, 20) if left else 0) == fewest(items, 20)
    used = np.zeros(21, int)
    for content, n in K.plan(hist):
        assert sum(s * k for s, k in content.items()) <= 20
        for s, k in content.items():
            used[s] += k * n
    assert (used == hist).all()


def test_pieces(docs, nothing):
    got = {r["doc_id"]: r for r in P.encode(docs, MODEL).collect()}
    for r in docs.where("doc_id is not null").collect():
        want = np.array(SP.encode(r["text"] or ""), "<u4")
        assert (got[r["doc_id"]]["n_ids"], got[r["doc_id"]]["ids_crc32"], got[r["doc_id"]]["same"]) == (len(want), zlib.crc32(want.tobytes()), True)
    assert P.encode(nothing, MODEL).count() == 0


def test_pieces_give_ids_and_texts(spark, docs, nothing):
    rows = P.decode(P.encode_ids(docs, MODEL), MODEL)
    assert dict(rows.dtypes)["ids"] == "array<int>" and rows.count() == docs.count() and P.decode(P.encode_ids(nothing, MODEL), MODEL).count() == 0
    for r in rows.collect():
        assert r["ids"] == SP.encode(r["text"]) and r["decoded"] == r["text"]
    some = spark.createDataFrame([(SP.encode("a text"),), ([],), (None,)], "ids array<int>")
    assert [r["decoded"] for r in P.decode(some, MODEL).collect()] == ["a text", "", None]


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError):
        C.Counter(public_tokenizers.path("word_bpe_49k.json"))
