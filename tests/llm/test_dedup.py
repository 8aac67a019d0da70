import hashlib
import random
import re

import numpy as np
import xxhash
from regionflow.llm import exact_dedup as E
from regionflow.llm import simhash as H
from regionflow.llm.components import components


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id))
    out = {}
    for norm, g in groups.items():
        keep = min(g, key=lambda x: (x[0], x[1] is None, x[1] or 0))[1]
        for _, doc_id in g:
            out[doc_id] = (keep, len(g), hashlib.sha256(norm.encode()).hexdigest())
    return out


def test_exact(docs, corpus):
    for df in (docs, corpus):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = E.exact_dedup(df).collect()
        want = brute([r for r in rows if r[0] is not None])
        assert len(got) == len(rows)
        if df is corpus:
            assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == want
        kept = [r["text_sha256"] for r in got if r["kept"]]
        assert len(kept) == len(set(kept)) == len({r["text_sha256"] for r in got})


def test_exact_on_odd_rows(docs):
    got = {}
    for r in E.exact_dedup(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert {got[k][0]["keep_id"] for k in (1, 2, 3)} == {2} and got[2][0]["kept"] and got[1][0]["group_size"] == 4  # one repeated row; of equal length the smaller id
    assert got[9][0]["keep_id"] == 9  # another case is another text
    assert {got[k][0]["keep_id"] for k in (4, 5, 6)} == {6} and got[None][0]["keep_id"] in (6, None)
    assert got[8][0]["keep_id"] == 7 and got[7][0]["n_chunks"] > 100


def test_chunks_are_by_content(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh" * 8 + ".") for _ in range(60_000))
    df = spark.createDataFrame([(1, text), (2, "xyz." * 200 + text)], "doc_id long, text string")
    a, b = (r["ids"] for r in E.recipes(df).orderBy("doc_id").collect())
    assert len(set(a) & set(b)) > 0.8 * len(a)  # cuts fall into step again behind an insertion
    parts = spark.createDataFrame([(text,), ("a" * 9_999,)], "t string").select(E.chunks(E.F.col("t")).alias("c")).collect()
    assert "".join(parts[0]["c"]) == text and all(512 <= len(c) <= 4096 for c in parts[0]["c"][:-1]) and [len(c) for c in parts[1]["c"]] == [4096, 4096, 1807]


def test_clashing_identifiers_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(E.F, "xxhash64", lambda c: E.F.lit(7).cast("long"))
    df = spark.createDataFrame([(1, "one"), (2, "two"), (3, "o ne")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in E.exact_dedup(df).collect()} == {1: 3, 2: 2, 3: 3}


def test_drop_copies(docs, corpus, nothing):
    out = E.drop_copies(docs)
    assert out.columns == docs.columns and E.drop_copies(nothing).count() == 0 and E.exact_dedup(nothing).count() == 0
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in docs.collect()})
    assert sorted(r["doc_id"] for r in E.drop_copies(corpus).collect()) == sorted({k for k, _, _ in brute([(r["doc_id"], r["text"]) for r in corpus.collect()]).values()})


def plain_print(text, words=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """prints: doc_id -> print."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def shingles(text, words=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def alike(texts, least=0.8):
    """Smallest document of each one's component, of links by resemblance; by trying all pairs."""
    ids = sorted(texts)
    sets, root = {i: shingles(texts[i]) for i in ids}, {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= least * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_similar_documents(spark, docs, nothing):
    """A crowd of near copies of one text, a chain, and texts of their own."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, texts = [word() for _ in range(200)], {}
    for k in range(60):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 6, 15])):
            copy[rng.randrange(200)] = word()
        texts[k] = " ".join(copy)
    chain = [word() for _ in range(150)]
    for k in range(100, 112):
        chain = chain[3:] + [word() for _ in range(3)]
        texts[k] = " ".join(chain)
    texts |= {k: " ".join(word() for _ in range(rng.randint(1, 60))) for k in range(200, 260)}
    got = {r["doc_id"]: r["component_id"] for r in H.similar_documents(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()}
    want = alike(texts)
    assert all(got[k] >= want[k] and want[got[k]] == want[k] for k in texts)  # nothing is linked that isn't alike
    linked = [k for k in texts if want[k] != k]
    assert len(linked) > 40 and sum(got[k] == want[k] for k in linked) >= 0.95 * len(linked)
    assert H.similar_documents(nothing).count() == 0 and H.similar_documents(docs).count() == docs.count()


def test_a_large_group_does_not_emit_its_pairs(spark, monkeypatch):
    """Copies of one text with few to many changes, most too far from each other: links are all found, and few pairs are verified."""
    rng, verified = random.Random(10), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, texts = [word() for _ in range(220)], {}
    for k in range(240):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 5, 8, 8, 10, 10, 12, 12])):
            copy[rng.randrange(220)] = word()
        texts[k] = " ".join(copy)
    whole = H.resembling
    monkeypatch.setattr(H, "resembling", lambda pairs, *more: verified.append(pairs.count()) or whole(pairs, *more))
    got = {r["doc_id"]: r["component_id"] for r in H.similar_documents(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()}
    assert got == alike(texts)
    assert sum(verified) < 8 * len(texts) < len(texts) ** 2 / 20, verified


def test_no_similar_pair_is_lost(spark):
    """Pairs a little over the least resemblance, each of texts of their own with one line that all have."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line, texts = " ".join(word() for _ in range(12)), {}
    for k in range(0, 400, 2):
        text, copy = [word() for _ in range(rng.randint(60, 300))], None
        while copy is None or not 0.8 <= len(a & b) / len(a | b) < 0.83:
            copy = list(text)
            for _ in range(rng.randint(1, len(text) // 30 + 1)):
                copy[rng.randrange(len(text))] = word()
            a, b = shingles(" ".join([*text, line])), shingles(" ".join([*copy, line]))
        texts |= {k: " ".join([*text, line]), k + 1: " ".join([*copy, line])}
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: r["component_id"] for r in H.similar_documents(df).collect()} == {k: k - k % 2 for k in texts}


def test_similar_documents_are_linked_by_fingerprint_first(spark, monkeypatch):
    """SimHash's index links alike texts by itself, with its links verified; shingles' postings find those that more bits part."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts, near, apart = {}, set(), set()
    for k in range(0, 120, 2):
        text = [word() for _ in range(400)]
        copy = [*text, word()] if k % 4 else [*text[:-30], *(word() for _ in range(30))]
        a, b = (H.set_fingerprint(H.shingle_hashes(" ".join(t), 5)) for t in (text, copy))
        (near if ((a ^ b) & (2**64 - 1)).bit_count() <= H.DISTANCE else apart).add(k)
        texts |= {k: " ".join(text), k + 1: " ".join(copy)}
    line = " ".join(word() for _ in range(4))
    few = {200: f"{line} x", 201: f"{line} y"}  # fingerprints of one shingle each: not alike
    df = spark.createDataFrame(sorted((texts | few).items()), "doc_id long, text string")
    linked = lambda: {r["doc_id"] for r in H.similar_documents(df).collect() if r["component_id"] != r["doc_id"]}
    assert len(near) > 20 and len(apart) > 20
    assert linked() == {k + 1 for k in near | apart}
    starred, pairs = H._starred, H._apart
    monkeypatch.setattr(H, "_starred", lambda *a: starred(*a).where("false"))
    monkeypatch.setattr(H, "_apart", lambda m, *more: pairs(m, *more).where(H.F.lit("place" not in more)))
    assert linked() == {k + 1 for k in near}
    monkeypatch.setattr(H, "near_in_bits", lambda reps: reps.select(H.F.col("node").alias("u"), H.F.lit(0).cast("long").alias("v")).where("false"))
    assert not linked()


def test_set_fingerprints(spark):
    for text in ("", "a", "a b c d e f", "x y z w v " * 300 + "end of it"):
        h = H.shingle_hashes(text, 5)
        assert H.set_fingerprint(h) & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h.view(np.uint64)) > len(h))
    assert H.set_fingerprint(H.shingle_hashes("a b c d e f g", 5)) == H.fingerprint("A b c d e f g", 5)


def test_repeated_lines_neither_link_nor_part(spark):
    """Texts are as alike as their distinct shingles are, however often a line is repeated."""
    own = lambda a, n: " ".join(f"w{a}x{k}" for k in range(n))
    line = " " + own("line", 11)
    texts = {1: own(1, 300) + 100 * line, 2: own(2, 300) + 100 * line, 3: own(1, 300) + 2 * line, 4: own(4, 1000) + 8 * line, 5: own(4, 1000) + line, 6: own(6, 9)}
    want = alike(texts)
    assert want == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4, 6: 6}
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in H.similar_documents(df).collect()} == want
    assert sorted(r["doc_id"] for r in H.drop_near_duplicates(df).collect()) == [1, 2, 4, 6]


def test_simhash(corpus):
    got = {r["doc_id"]: r for r in H.near_duplicates(corpus).collect()}
    prints = {r["doc_id"]: plain_print(r["text"]) for r in corpus.collect()}
    assert {k: r["fingerprint"] for k, r in got.items()} == {k: f"{p:016x}" for k, p in prints.items()}
    assert {k: r["component_id"] for k, r in got.items()} == plain_components(prints)


def test_simhash_on_odd_rows(docs, nothing):
    got = {}
    for r in H.near_duplicates(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for r in docs.collect():
        assert got[r["doc_id"]][0]["fingerprint"] == f"{plain_print(r['text']):016x}" or r["doc_id"] is None
    assert {got[k][0]["component_id"] for k in (4, 5, 6)} == {4} and got[4][0]["fingerprint"] == "0" * 16
    assert len(got[1]) == 2 and got[8][0]["component_id"] == 7
    assert H.near_duplicates(nothing).count() == 0
    out = H.drop_near_duplicates(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} >= {4, 7, 13} and not {5, 6, 8} & {r["doc_id"] for r in out.collect()}


def test_dropping_rows_that_share_a_doc_id(spark):
    text = lambda a: " ".join(f"w{a}x{k}" for k in range(300))
    near = text(1) + " more"
    rows = [(1, text(1)), (5, near), (5, text(2)), (5, text(2) + " end"), (6, text(2)), (7, text(3)), (7, text(3)), (None, text(1)), (None, text(1)), (8, text(4))]
    out = H.drop_near_duplicates(spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _first int").repartition(3))
    assert out.columns == ["doc_id", "text", "_first"]
    got = [(r["doc_id"], r["text"].split()[0]) for r in out.collect()]
    assert sorted(g for g in got if g[0]) == [(1, "w1x0"), (5, "w2x0"), (7, "w3x0"), (8, "w4x0")]
    assert sum(g[0] is None for g in got) == 2


def test_links_in_crowded_lists(spark):
    """Chains and crowds in which most pairs share many bytes: no link is lost."""
    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(25):
            prints.add(p)
            for _ in range(rng.randint(1, 5)):
                p ^= 1 << rng.choice([0, 1, 2, 3, 17, 18, 40, 63])
    prints |= {rng.getrandbits(64) for _ in range(200)} | {0, 15, 31}
    signed = sorted(int(np.uint64(p).astype(np.int64)) for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    want = {}
    for p, c in plain_components({s: s & (2**64 - 1) for s in signed}).items():
        want.setdefault(c, set()).add(p)
    for crowded in (H.CROWDED, 4):
        part = {r["node"]: r["component"] for r in H.link_prints(df, crowded).collect()}
        got = {}
        for p in signed:
            got.setdefault(part.get(p, p), set()).add(p)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_count_filter_goes_by_meetings(spark):
    """Of pairs that meet, those alone are verified that share four bytes: the others meet once."""
    rng = random.Random(6)
    a = rng.getrandbits(64)
    other = lambda n: a ^ sum(rng.randrange(1, 256) << 8 * p for p in rng.sample(range(8), n))  # noqa: E731 - other in n bytes
    signed = lambda p: int(np.uint64(p).astype(np.int64))
    sharing = {signed(other(n)): 8 - n for n in (5, 5, 5, 4, 4, 3, 1)}
    rows = spark.createDataFrame([(signed(a), p) for p in sharing], "a long, b long")
    met = rows.select("a", "b", H.F.explode(H.F.arrays_zip(*[H.F.array(*[H._key("a", k, s) == H._key("b", k, s) for k, s in enumerate(H.sets_of_positions(3))]).alias("same")])).alias("m")).where("m.same")
    met = met.select(H.F.col("a").alias("u"), H.F.col("b").alias("v"))
    assert {r["v"] for r in met.distinct().collect()} == set(sharing)
    assert {r["v"] for r in H.counted(met, H.least_meetings(3)).collect()} == {p for p, n in sharing.items() if n >= 4}


def test_posted_sets_tell_who_shares_four_bytes():
    """Whichever four bytes two fingerprints share, they meet as often as the count filter asks for; who shares three meets less often."""
    sets = H.posted_sets(3)
    least = H.least_meetings(3, sets=sets)
    meetings = lambda same: sum(set(s) <= set(same) for s in sets)
    assert len(sets) == 34 and least == 2
    assert all(meetings(same) >= least for n in range(4, 9) for same in H.combinations(range(8), n))
    assert all(meetings(same) < least for n in range(4) for same in H.combinations(range(8), n))
    assert H.posted_sets(4) == H.sets_of_positions(4) and H.least_meetings(4, sets=H.posted_sets(4)) == 1


def test_a_crowd_of_near_copies_joins_few_postings(spark, monkeypatch):
    """Joins by list give each fingerprint of a crowd 34 rows at most, and no link is lost."""
    rng = random.Random(8)
    p = rng.getrandbits(64)
    prints = {p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(3, 5))) for _ in range(600)}
    signed = sorted(int(np.uint64(x).astype(np.int64)) for x in prints)
    joined, settle = [], H.settle

    def counting(df):
        out = settle(df)
        if {"key", "head"} <= set(out.columns) or {"key", "members"} <= set(out.columns):
            joined.append(out.count())
        return out

    monkeypatch.setattr(H, "settle", counting)
    part = {r["node"]: r["component"] for r in H.link_prints(spark.createDataFrame([(x,) for x in signed], "print long")).collect()}
    assert joined[0] > 20 * len(signed) and max(joined) <= 34 * len(signed)
    got, want = {}, {}
    for x, c in plain_components({x: x & (2**64 - 1) for x in signed}).items():
        want.setdefault(c, set()).add(x)
        got.setdefault(part.get(x, x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_postings_are_not_broadcast(spark, monkeypatch):
    """A short table of fingerprints has many postings, of which Spark's estimate knows nothing."""
    met, whole = [], H.settle
    monkeypatch.setattr(H, "settle", lambda df: ({"key", "head"} <= set(df.columns) and met.append(df)) or whole(df))
    prints = spark.range(1000).select(H.F.explode(H.F.array("id", H.F.col("id") + (1 << 40))).alias("print"))
    H.print_links(prints)
    assert len(met[0].collect()) > 0 and "BroadcastHashJoin" not in met[0]._jdf.queryExecution().executedPlan().toString()


def test_postings_of_shingles_are_not_broadcast(corpus, monkeypatch):
    class Met(Exception):
        pass

    def until(df):
        if set(df.columns) == {"key", "node", "place"}:
            raise Met(df)
        return whole(df)

    whole = H.settle
    monkeypatch.setattr(H, "settle", until)
    try:
        H.similar_documents(corpus)
    except Met as e:
        (met,) = e.args
    assert len(met.collect()) > 0 and "BroadcastHashJoin [key" not in met._jdf.queryExecution().executedPlan().toString()


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 100: 90}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
