"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length into buckets, and buckets into blocks of bounded size. A pilot gives every query a score that its
k-th best reaches at least. Against a bucket's greatest length this is a cosine that a result needs there: over 1, the bucket is
skipped; high, candidates are pruned by the ranges that it leaves for the query's largest coordinates; else by length alone. What is
left is verified by products. Queries, a hundredth of the rows, travel to the blocks in shares of bounded size, so that a task holds one
block and one share however many there are; candidates are shuffled once for each share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

SCALE, K, EVERY = 1024, 10, 100
#: Rows of a block, of a share of the queries, of the pilot, and queries handled at a time. Queries move once for each block and candidates
#: once for each share.
BLOCK_ROWS, SHARE_ROWS, PILOT_ROWS, QUERIES_AT_ONCE = 32_768, 131_072, 4096, 128
#: Buckets that are looked up by broadcast; more are joined by a shuffle.
LOOKED_UP_MOST = 100_000
#: Lengths of a bucket differ by this factor at most; local cosines from which coordinates are pruned, and how many are.
STEP, COORDINATES_FROM, COORDINATES = 1.05, 0.8, 4
#: Products of doubles are exact below this.
EXACT = 2.0**53
RESULT = "query_uid long, query_id long, vec_id long, uid long, score long"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """uid, vec_id, v, dim and norm of the vectors that take part: not null, not empty, all components finite."""
    x = F.col("embedding").cast("array<double>")
    fit = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False)))
    rows = fit.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(scale * e).cast("long")).alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    return rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "v", F.size("v").alias("dim"), F.sqrt(squares).alias("norm"))


def matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), np.int64).reshape(len(v), -1)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where that is exact, else in integers."""
    if q.size and c.size and q.shape[1] * float(np.abs(q).max()) * float(np.abs(c).max()) < EXACT:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _pilot(parts: Iterator[pd.DataFrame], ids: np.ndarray, sample: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """Adds to each query the k-th best of its scores with the sample, itself left out: a bound from below."""
    for p in parts:
        for at in range(0, len(p), QUERIES_AT_ONCE):
            q = p.iloc[at : at + QUERIES_AT_ONCE].copy()
            bound = np.full(len(q), np.iinfo(np.int64).min)
            same = (q["dim"] == sample.shape[1]).to_numpy()
            if same.any() and len(ids) > k:
                s = products(matrix(q.loc[same, "v"]), sample)
                s[q.loc[same, "uid"].to_numpy()[:, None] == ids[None, :]] = np.iinfo(np.int64).min
                bound[same] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            yield q.assign(bound=bound)


def _kept(q: np.ndarray, q_norm: float, need: float, c: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Places of a block's candidates (longest first) that may reach the score ``need`` with q."""
    if need <= 0 or q_norm == 0:
        return np.arange(len(c))
    by_length = int(np.searchsorted(-norms, -need / q_norm * (1 - 1e-9), "right"))
    at = np.arange(by_length)
    if not by_length or (local := need / (q_norm * norms[0])) < COORDINATES_FROM:
        return at
    local = min(1.0, local) * (1 - 1e-9)
    unit = q / q_norm
    for f in np.argsort(-np.abs(unit))[:COORDINATES]:
        spread = math.sqrt(max(0.0, (1 - unit[f] ** 2) * (1 - local**2))) + 1e-9
        x = c[at, f] / np.maximum(norms[at], 1e-300)
        # within the cone, x lies in this range; where the axis itself does, on the query's side it may be anything up to one
        low, high = unit[f] * local - spread, unit[f] * local + spread
        if abs(unit[f]) >= local - 1e-6:
            low, high = (low, np.inf) if unit[f] > 0 else (-np.inf, high)
        at = at[(x >= low) & (x <= high)]
    return at


def _block(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of a block for each query that came to it."""
    out = [(np.empty(0, np.int64),) * 5]
    if len(queries) and len(block):
        block = block.sort_values(["norm", "vec_id", "uid"], ascending=[False, True, True])
        c, ids, uids, norms = matrix(block["v"]), block["vec_id"].to_numpy(), block["uid"].to_numpy(), block["norm"].to_numpy()
        for at in range(0, len(queries), QUERIES_AT_ONCE):
            part = queries.iloc[at : at + QUERIES_AT_ONCE]
            q, local = matrix(part["v"]), part["bound"].to_numpy() / np.maximum(part["norm"].to_numpy() * norms[0], 1e-300)
            whole = products(q, c) if (local < COORDINATES_FROM).any() else None
            for i, (uid, vec_id, norm, bound) in enumerate(zip(part["uid"], part["vec_id"], part["norm"], part["bound"], strict=True)):
                places = np.arange(len(c)) if local[i] < COORDINATES_FROM else _kept(q[i], norm, float(bound), c, norms)
                scores = whole[i] if local[i] < COORDINATES_FROM else products(q[i : i + 1], c[places])[0]
                keep = (scores >= bound) & (uids[places] != uid)
                places, scores = places[keep], scores[keep]
                top = best(scores, ids[places], k)
                own = np.full((2, len(top)), [[uid], [vec_id]], np.int64)
                out.append((*own, ids[places][top], uids[places][top], scores[top]))
    return pd.DataFrame(dict(zip((c.split(" ")[0] for c in RESULT.split(", ")), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` its ``k`` highest integer inner products
    with all other rows, ties to the smaller vec_id; all of them if there are fewer.

    Vectors that are null or empty, or hold null or non-finite components, take no part, nor do rows without vec_id. Vectors of
    different dimension are not compared. Repeated rows are rows: each is a candidate of the others, and each query row has its own ranks.
    An empty table gives an empty result; further columns are ignored.
    """
    rows = settle(quantised(vectors, scale))
    bucket = F.when(F.col("norm") > 0, F.floor(F.log("norm") / math.log(STEP))).otherwise(-1)
    rows = rows.withColumn("bucket", bucket)
    stats = rows.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest"))
    stats = settle(stats.withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")))
    queries = rows.where(F.col("vec_id") % every == 0)
    shares = settle(queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / SHARE_ROWS).cast("int").alias("shares")))
    small = F.broadcast if stats.count() <= LOOKED_UP_MOST else (lambda df: df)  # there are no more shares than buckets
    turn = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")  # noqa: E731 - not by vec_id, which may stand before many rows
    dealt = rows.join(small(stats.select("dim", "bucket", "blocks")), ["dim", "bucket"]).withColumn("block", turn("blocks"))
    dealt = dealt.join(small(shares), "dim").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    pilot = rows.orderBy(F.desc("norm"), F.xxhash64("vec_id"), "vec_id", "uid").limit(PILOT_ROWS).toPandas()  # PILOT_ROWS at most
    pilot = pilot[pilot["dim"] == pilot["dim"].mode().iloc[0]] if len(pilot) else pilot
    sample = matrix(pilot["v"]) if len(pilot) else np.empty((0, 0), np.int64)
    kinds = "uid long, vec_id long, v array<long>, dim int, norm double, share int"
    asked = queries.join(small(shares), "dim").withColumn("share", turn("shares")).select(*[c.split(" ")[0] for c in kinds.split(", ")])
    bounded = asked.mapInPandas(partial(_pilot, ids=pilot["uid"].to_numpy(), sample=sample, k=k), kinds + ", bound long")
    possible = (F.col("bound") <= 0) | (F.col("norm") * F.col("longest") * (1 + 1e-9) >= F.col("bound"))
    sent = bounded.join(small(stats.select("dim", "bucket", "longest", "blocks")), "dim").where(possible)
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = ["dim", "bucket", "block", "share"]
    near = sent.select(*place, "uid", "vec_id", "v", "norm", "bound").groupBy(*place).cogroup(dealt.select(*place, "uid", "vec_id", "v", "norm").groupBy(*place))
    return ranked(near.applyInPandas(partial(_cogrouped, k=k), RESULT), k)


def _cogrouped(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    return _block(queries, block, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Ranks from 1 within each query's k best; a query has k rows from each block at most."""
    from pyspark.sql import Window as W

    order = W.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
