"""Best-fit packing after Martello-Toth dominance reduction.

Pieces are known by their length alone, so the instance is a histogram with at most ``capacity`` classes however large the corpus.
The reduction fixes, for whole classes at a time, small sets that provably dominate every alternative for their largest piece; the
shrunken rest is packed by best fit. The outcome is a bounded list of patterns, and each piece finds its place by its rank among the
pieces of its length.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle, whole
from .pretokens import PATTERN, Splitter, TokenizerFile, byte_letters

CAPACITY, END_ID = 1024, 2
#: Pieces of one length are ranked in groups of so many, or of the inverse share of all pieces if that is more: no length is a hot key, and
#: there are no more groups than this besides one for each length.
GROUP_ROWS, GROUPS_MOST = 256, 10_000


def dominant(hist: np.ndarray, j: int) -> Counter | None:
    """A set with a piece of length j that dominates every other set with such a piece, if the criterion finds one."""
    room, left = len(hist) - 1 - j, hist.copy()
    left[j] -= 1
    fit = np.flatnonzero(left[: room + 1])
    if not len(fit):
        return Counter([j])
    small = [s for s in fit[:3] for _ in range(min(3, int(left[s])))][:3]
    k = int(fit[-1])
    if k == room or len(small) < 2 or small[0] + small[1] > room:
        return Counter([j, k])
    if len(small) == 3 and sum(small) <= room:
        return None  # more than two others fit: the criterion has nothing to say
    lo, hi, best = 0, len(fit) - 1, (0, 0, 0)
    while lo <= hi:
        a, b = int(fit[hi]), int(fit[lo])
        if a + b > room or (lo == hi and left[a] < 2):
            hi -= 1
            continue
        best = max(best, (a + b, a, b))
        lo += 1
    total, a, b = best
    if k >= total:
        return Counter([j, k])
    between = [s for s in range(b + 1, a) for _ in range(min(2, int(left[s])))][:2]
    if a == k and (len(between) < 2 or sum(between) > room):
        return Counter([j, a, b])
    return None


def reduce(hist: np.ndarray) -> tuple[list[tuple[Counter, int]], np.ndarray]:
    """Sets that are fixed, with how often, and the histogram that remains. What dominates once does so until one of its lengths is
    used up, because taking pieces away adds no alternative."""
    fixed, hist, changed = [], hist.copy(), True
    while changed:
        changed = False
        for j in np.flatnonzero(hist)[::-1]:
            while hist[j] and (f := dominant(hist, int(j))):
                times = min(int(hist[s]) // n for s, n in f.items())
                for s, n in f.items():
                    hist[s] -= times * n
                fixed.append((f, times))
                changed = True
    return fixed, hist


def best_fit(hist: np.ndarray) -> list[tuple[Counter, int]]:
    """Best fit, longest first, over whole classes: bins with equal content are handled together."""
    capacity = len(hist) - 1
    open_bins: dict[int, list[tuple[Counter, int]]] = defaultdict(list)
    for s in map(int, np.flatnonzero(hist)[::-1]):
        n = int(hist[s])
        while n:
            room = min((r for r in open_bins if r >= s), default=None)
            if room is None:
                each = capacity // s
                for times, count in ((n // each, each), (1, n % each)):
                    if times and count:
                        open_bins[capacity - s * count].append((Counter({s: count}), times))
                break
            content, times = open_bins[room].pop()
            took = min(n, times)
            if took < times:
                open_bins[room].append((content, times - took))
            if not open_bins[room]:
                del open_bins[room]
            open_bins[room - s].append((content + Counter([s]), took))
            n -= took
    return [x for group in open_bins.values() for x in group]


def plan(hist: np.ndarray) -> list[tuple[Counter, int]]:
    """Patterns and how often each is used; hist[s] is the number of pieces of length s, its last index the capacity."""
    fixed, rest = reduce(np.asarray(hist, np.int64))
    return fixed + best_fit(rest)


def slots(patterns: Iterable[tuple[Counter, int]]) -> pd.DataFrame:
    """For each length, which ranks go to which sequences and offsets: rank first..first+times-1 to sequences base onward."""
    rows, used, base = [], Counter(), 0
    for content, times in patterns:
        offset = 0
        for s in sorted(content, reverse=True):
            for _ in range(content[s]):
                rows.append((s, used[s], base, offset))
                used[s] += times
                offset += s
        base += times
    return pd.DataFrame(rows, columns=["length", "first", "base", "offset"], dtype="int64").sort_values(["length", "first"], ignore_index=True)


class Encoder:
    """Token ids of texts as little-endian bytes. The file's merges are run by tiktoken, whose ids are the same and which is faster;
    tests hold it against the tokenizers library, which encodes where a file's ids don't follow its merges."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        file, value = TokenizerFile(path), {c: b for b, c in enumerate(byte_letters())}
        self.library, self.fast = Tokenizer.from_file(path), None
        made = [file.vocab[a + b] for a, b in file.merges]
        if made == list(range(made[0], made[0] + len(made))) and made[0] == 256:
            ranks = {bytes(value[c] for c in t): i for t, i in file.vocab.items() if t not in file.specials}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=file.specials)
        self.windows = Splitter(file.specials).windows

    def __call__(self, texts: Iterable[str]) -> Iterator[bytes]:
        for t in texts:
            if self.fast:
                yield b"".join(self.fast.encode_to_numpy(w, allowed_special="all").astype("<u4").tobytes() for w in self.windows(t))
            else:
                yield np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and tokenizer."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of a document's pieces: only the first may be shorter than the capacity."""
    at = 0
    while at < length:
        n = (length - at - 1) % capacity + 1 if at == 0 else capacity
        yield at, n
        at += n


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    encode, last = encoder(path), np.uint32(end).astype("<u4").tobytes()
    names = [c.split(" ")[0] for c in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    for b in batches:
        out = [[] for _ in names]
        for doc, ids in zip(b.column("doc_id"), encode(x.as_py() for x in b.column("text")), strict=True):
            ids, doc = memoryview(ids + last), doc.as_py()
            for k, (at, n) in enumerate(cut(len(ids) // 4, capacity)):
                for col, v in zip(out, (doc, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


def _place(parts: Iterator[pd.DataFrame], table: pd.DataFrame, span: int) -> Iterator[pd.DataFrame]:
    key = (table["length"] * span + table["first"]).to_numpy()
    for p in parts:
        at = np.searchsorted(key, (p["length"] * span + p["rank"]).to_numpy(), "right") - 1
        row = table.iloc[at].reset_index(drop=True)
        p["sequence_id"] = (row["base"] + p["rank"].reset_index(drop=True) - row["first"]).to_numpy()
        p["offset"] = row["offset"].to_numpy()
        yield p.drop(columns="rank")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of ``docs`` is packed, repeated ones too. A null text counts as empty: its document is the end id alone. A null doc_id
    stays null. An empty table gives an empty result; further columns are ignored. A piece as long as the capacity is a sequence by
    itself, with a negative number.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    pieces = settle(rows.mapInArrow(partial(_pieces, path=path, capacity=capacity, end=end), PIECES).withColumn("uid", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pieces.where(F.col("length") < capacity)
    found = {r["length"]: r["count"] for r in short.groupBy("length").count().collect()}  # one row for each length
    hist = np.zeros(capacity + 1, np.int64)
    hist[list(found)] = list(found.values())
    each = max(GROUP_ROWS, int(hist.sum()) // GROUPS_MOST)
    salts = spark.createDataFrame([(n, -(-k // each)) for n, k in found.items()], "length long, salts long")
    salted = short.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("salts")))
    counts = settle(salted.groupBy("length", "salt").count())
    before = counts.select("length", "salt", (F.sum("count").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, 0)) - F.col("count")).alias("before"))
    nth = F.row_number().over(W.partitionBy("length", "salt").orderBy("uid")) - 1
    ranked = salted.withColumn("nth", nth).join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    span = int(hist.max()) + 1
    placed = ranked.mapInPandas(partial(_place, table=slots(plan(hist)), span=span), PIECES + ", sequence_id long, offset long")
    return full.unionByName(placed)
