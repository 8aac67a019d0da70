import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from regionflow.llm import language as L
from regionflow.llm import toxicity as X
from regionflow.llm.boosting import Boosted, Isotonic


def test_language_on_held_out_rows(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.predict(corpus).join(corpus.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_on_odd_rows(docs, nothing):
    got = {r["doc_id"]: r for r in L.predict(docs).collect()}
    assert {got[k]["lang_pred"] for k in (4, 5, 6, 15)} == {"und"} and got[1]["lang_pred"] == "en" and got[None]["held_out"]
    assert L.predict(docs).count() == docs.count() and L.predict(nothing).count() == 0
    out = L.drop_rejected(docs)
    assert out.columns == docs.columns and {1, 7, 10} <= {r["doc_id"] for r in out.collect()} and not {4, 5, 6, 15} & {r["doc_id"] for r in out.collect()}


def plain_cosine(text, prototype):
    """Letter by letter, by the definitions."""
    low, n = "".join(c if c.isalpha() else " " for c in (text or "").lower()), L.DIMENSIONS
    low = " " + " ".join(low.split()) + " "
    of = lambda c: L.letter_vectors(np.array([ord(c) if c != " " else 0]))[0].tolist()
    letters, bundle = {c: of(c) for c in set(low)}, [0] * n
    for a, b, c in zip(low, low[1:], low[2:], strict=False):
        if b != " ":
            x, y, z = letters[a], letters[b], letters[c]
            bundle = [s + x[(i - 2) % n] * y[(i - 1) % n] * z[i] for i, s in enumerate(bundle)]
    return float(np.dot(bundle, prototype) / np.linalg.norm(bundle))


def test_scores_are_cosines_of_bundles(spark, corpus):
    model = L.learn(corpus)
    texts = [(k, t) for k, t in enumerate(["the quick brown fox and the dog", "Der Hund, und die Katze!", "12 中文字 и кот", "é", *(r["text"][:400] for r in corpus.where("text is not null").limit(4).collect())])]
    got = {r["doc_id"]: r for r in L.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for k, t in texts:
        cosines = [plain_cosine(t, p) for p in model.prototypes]
        assert got[k]["score"] == pytest.approx(min(1, max(0, max(cosines))), abs=1e-6) and got[k]["lang_pred"] == model.languages[int(np.argmax(cosines))]


def test_letters_of_any_script_count(spark):
    """Languages of other scripts than most of the learned texts."""
    pools = {"en": "abcdefghijklmnopqrstuvwxyz", "ru": "абвгдежзиклмнопрст", "el": "αβγδεζηθικλμνοπρστ", "zh": "".join(map(chr, range(0x4E00, 0x4E14))), "ja": "".join(map(chr, range(0x3042, 0x3060, 2))), "ko": "".join(map(chr, range(0xAC00, 0xAC14)))}
    rng = np.random.default_rng(1)
    text = lambda pool: "".join(rng.choice(list(pool + " "), 300))
    rows = [(k, lang, text(pools[lang])) for k, lang in enumerate(["en"] * 300 + [x for x in pools if x != "en"] * 20)]
    got = L.predict(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()
    want = {k: lang for k, lang, _ in rows}
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in got]) > 0.99


def test_windows_count_alike(monkeypatch):
    text = "The cat. And 12 hats, then more! " * 50
    whole = L.counted(text)
    monkeypatch.setattr(L, "WINDOW", 37)
    parts = L.counted(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_toxicity_on_held_out_rows(spark):
    place = "/root/testdata/sf0.1"
    corpus, labels = (spark.read.parquet(f"{place}/{t}.parquet") for t in ("documents", "labels"))
    got = X.score(corpus, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in got if r["toxic"] == 1]
    assert np.mean([r["predicted"] == 1 for r in toxic]) > 0.8
    assert np.mean([r["predicted"] == 0 for r in got if r["toxic"] == 0]) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_the_lexicon_does_not_depend_on_partitions(spark):
    """Ordinary words are in many clean texts that no toxic one shares a partition with."""
    rows = [(k, f"plain words of every day {'blarg' if k % 10 == 0 else 'calm'}", int(k % 10 == 0)) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = [X.learn(df.select("doc_id", "text").repartitionByRange(n, "doc_id"), df.select("doc_id", "toxic")).lexicon for n in (1, 8, 200)]
    assert found == [{"blarg"}] * 3


def test_toxicity_on_odd_rows(spark, docs, labels, nothing):
    none = labels.where("false")
    assert X.score(nothing, labels).count() == 0 and X.score(docs, none).count() == docs.count()
    one = X.score(docs, docs.select("doc_id").distinct().selectExpr("doc_id", "1 AS quality", "0 AS toxic")).collect()
    assert {r["predicted"] for r in one} == {0}
    twice = spark.createDataFrame([(k, q, t) for k in range(200) for q, t in ((0, 0), (None, int(k % 5 == 0)), (1, None))], "doc_id long, quality int, toxic int")
    assert X.score(docs, twice).count() == docs.count()


def test_features_see_what_they_name():
    plain, bad = X.features("you are kind and the day is fine"), X.features("you are an idiot and a m0ron")
    assert plain[0] == 0 and bad[0] > 0 and bad[5] > 0 and bad[12] > 0 and X.features(None).tolist() == X.features("").tolist()
    assert X.features("SHOUT")[7] == 1 and X.features("word " * 300_000)[13] > 12


def plain_features(text, lexicon):
    """By the definitions, over the whole text at once."""
    import math
    import re

    low, n = text.lower(), 0
    words = re.findall(r"[^\W\d_]+(?:[0134579@$!|*]+[^\W\d_]+)*", low)
    n, raw = max(1, len(words)), text.encode()
    hit = [w in X.INSULTS or w in lexicon for w in words]
    you = [w in X.YOU for w in words]
    near = sum(h and any(you[max(0, k - X.NEAR) : k + X.NEAR + 1]) for k, h in enumerate(hit))
    upper, lower = sum(65 <= b < 91 for b in raw), sum(97 <= b < 123 or b >= 192 for b in raw)
    odd = [w for w in set(words) if X.DISGUISED.search(w)]
    clear = lambda w: X.DISGUISED.sub("", w.translate(X.LEET))
    hidden = sum(words.count(w) for w in odd if clear(w) in X.INSULTS or clear(w) in lexicon)
    marks = sum(35 <= b < 48 or 91 <= b < 97 or 58 <= b < 65 for b in raw)
    insults, learned = sum(w in X.INSULTS for w in words), sum(w in lexicon for w in words)
    kinds = len({w for w, h in zip(words, hit, strict=True) if h})
    rates = [insults / n, learned / n, *(math.log1p(v) for v in (insults, learned, kinds, near)), sum(you) / n, upper / max(1, upper + lower)]
    return [*rates, text.count("!") / n, text.count("?") / n, marks / n, len(odd) / n, math.log1p(hidden), math.log1p(len(words))]


def test_scores_against_a_plain_scorer(spark, corpus, labels):
    """Features, trees and calibration step by step, as the definitions have them."""
    model = X.learn(corpus, labels)
    rows = [(k, t) for k, t in enumerate(["you are an idiot! a m0ron", "", "Sind SIE da?", *(r["text"] for r in corpus.where("text is not null").limit(40).collect())])]
    got = {r["doc_id"]: r["score"] for r in X.score(spark.createDataFrame(rows, "doc_id long, text string"), labels.where("false")).collect()}
    assert set(got) == {k for k, _ in rows}
    for _, text in rows:
        x = plain_features(text, model.lexicon)
        margin = model.trees.start
        for tree in model.trees.trees:
            node = 0
            while node < len(tree.feature):
                node = 2 * node + 1 + int(x[tree.feature[node]] > tree.cut[node])
            margin += tree.value[node - len(tree.feature)]
        at, value = model.scale.at, model.scale.value
        want = float(np.interp(margin, at, value))
        assert X.features(text, model.lexicon).tolist() == pytest.approx(x) and model.score([text])[0] == pytest.approx(min(1, max(0, want)))


def test_windows_part_no_word_and_keep_distances(monkeypatch):
    text = "you are so very much a moron and we know it m0ron idiot! " * 40
    whole = X.features(text)
    for width in (1, 7, 50, 333):
        monkeypatch.setattr(X, "WINDOW", width)
        assert "".join(X.windows(text)) == text and X.features(text).tolist() == whole.tolist()


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    margin = Boosted().fit(x[:1500], y[:1500]).margin(x[1500:])
    assert ((margin > 0) == (y[1500:] > 0)).mean() > 0.95


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(-9, 9), st.integers(0, 1)), min_size=1, max_size=40))
def test_calibration_rises(pairs):
    x, y = (np.array(v, float) for v in zip(*pairs, strict=True))
    fit = Isotonic().fit(x, y)
    out = fit(np.linspace(-10, 10, 50))
    assert (np.diff(out) >= -1e-12).all() and out.min() >= 0 and out.max() <= 1
