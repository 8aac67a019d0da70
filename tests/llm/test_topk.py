import numpy as np
import pytest
from regionflow.llm import topk as K


def brute(rows, k=10, every=100):
    """rows: (vec_id, list). Only vectors of one dimension meet."""
    out = []
    good = [(i, np.floor(1024 * np.array(v, float)).astype(object)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for a, (i, q) in enumerate(good):
        if i % every == 0:
            found = sorted((-int(sum(q * c)), j) for b, (j, c) in enumerate(good) if a != b and len(c) == len(q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found[:k], 1)]
    return sorted(out)


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, bucket string, norm int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in K.top_k(df, **kw).collect()) == brute(rows, **kw)


@pytest.mark.parametrize("kind", ["unit", "spread", "clusters", "ties"])
def test_exact(spark, kind, monkeypatch):
    monkeypatch.setattr(K, "PILOT_ROWS", 60)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "spread":
        v *= np.exp(rng.normal(size=(600, 1)) * 2)
    if kind == "clusters":
        v = np.repeat(v[:20], 30, 0) + rng.normal(size=(600, 8)) * 0.02
    if kind == "ties":
        v = np.repeat(v[:3], 200, 0)
    check(spark, [(i, x.tolist()) for i, x in enumerate(v)], every=20)


def test_blocks_and_shares(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", 40)
    monkeypatch.setattr(K, "SHARE_ROWS", 7)
    monkeypatch.setattr(K, "PILOT_ROWS", 50)
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 6)) * rng.choice([1, 3], (400, 1)))]
    check(spark, [*rows, *[(1000 + i, v[:4]) for i, v in rows[:90]]], every=4)
    for limit in (0, 100):
        monkeypatch.setattr(K, "LOOKED_UP_MOST", limit)
        check(spark, rows[:150], every=4)


def test_a_vec_id_of_many_vectors_is_dealt_out(spark, monkeypatch):
    """One vec_id holds most rows; its vectors are candidates of every other query, and its blocks are not one block."""
    monkeypatch.setattr(K, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 6)).astype(np.float32).tolist()
    rows = [(7 if i % 3 else i * 100, x) for i, x in enumerate(v)]
    got = K.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    whole = [(i, np.floor(1024 * np.array(x, float)).astype(int)) for i, x in rows]
    for i, q in whole:
        if i % 100 == 0:
            best = sorted((-int(q @ c), j) for j, c in whole if j != i)[:10]
            assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i] == [(j, -s) for s, j in best]


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (100, [0.0, 0.0]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (None, [1.0, 1.0]), (6, [-3.0, 4.0]), (7, [1.0, 2.0, 3.0]), (200, [5.0, 1.0, 1.0]), (8, [-1e9, 2e9])]
    check(spark, rows)
    check(spark, [])
    check(spark, [(100, [1.0])])
    check(spark, [*rows[:1], (6, [1.0, 1.0])])


def test_repeated_rows_are_rows(spark):
    """Of one vec_id and vector, of one vec_id alone, and of one vector alone; queries among them."""
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=3).tolist()) for i in (0, 100, *range(1, 8))]
    check(spark, [*rows, *rows[:5], (100, [1.0, 1.0, 1.0]), (9, rows[0][1]), *[(5, rows[3][1])] * 12])


def test_pruning_by_coordinates_loses_nothing():
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    c = np.rint(1024 * (base + rng.normal(size=(500, 8)) * rng.choice([0.05, 0.5, 2], (500, 1)))).astype(np.int64)
    norms = np.linalg.norm(c, axis=1)
    order = np.argsort(-norms)
    c, norms = c[order], norms[order]
    q = np.rint(1024 * base).astype(np.int64)
    scores = c @ q
    pruned = 0
    for need in np.quantile(scores, [0.5, 0.9, 0.99]).astype(int):
        kept = set(K._kept(q, float(np.linalg.norm(q)), float(need), c, norms).tolist())
        assert set(np.flatnonzero(scores >= need).tolist()) <= kept
        pruned += 500 - len(kept)
    close = c[norms < 1.3 * np.linalg.norm(q)]
    n = np.linalg.norm(close, axis=1)
    need = 0.97 * np.linalg.norm(q) * n[0]
    kept = K._kept(q, float(np.linalg.norm(q)), float(need), close, n)
    assert len(kept) < len(close) and set(np.flatnonzero(close @ q >= need).tolist()) <= set(kept.tolist())


@pytest.mark.parametrize("sign", [1, -1])
def test_pruning_keeps_what_is_nearer_the_axis(sign):
    """Queries and candidates that one coordinate dominates, on either side of it."""
    rng = np.random.default_rng(8)
    for tilt in (0.0, 0.1, 0.3, 0.5):
        side = rng.normal(size=(400, 5)) * rng.choice([0.0, 0.1, 0.4], (400, 1))
        c = np.c_[np.full(400, float(sign)), side]
        c = np.rint(1024 * c / np.linalg.norm(c, axis=1, keepdims=True)).astype(np.int64)
        norms = np.linalg.norm(c, axis=1)
        order = np.argsort(-norms)
        c, norms = c[order], norms[order]
        q = np.rint(1024 * np.array([sign, tilt, 0, 0, 0, 0]) / np.hypot(1, tilt)).astype(np.int64)
        for local in (0.8, 0.85, 0.9, 0.95, 0.99):
            need = local * np.linalg.norm(q) * norms[0]
            kept = K._kept(q, float(np.linalg.norm(q)), float(need), c, norms)
            assert set(np.flatnonzero(c @ q >= need).tolist()) <= set(kept.tolist())


@pytest.mark.parametrize("sign", [1, -1])
def test_dominated_vectors(spark, sign, monkeypatch):
    monkeypatch.setattr(K, "PILOT_ROWS", 60)
    rng = np.random.default_rng(9)
    v = np.c_[np.full(300, float(sign)), rng.normal(size=(300, 4)) * rng.choice([0.0, 0.2, 0.6], (300, 1))]
    check(spark, [(i, x.tolist()) for i, x in enumerate(v / np.linalg.norm(v, axis=1, keepdims=True))], every=10)
