"""Token counts by rank-synchronous array merging (see ``pretokens.Merger``), in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole
from .pretokens import KNOWN_MOST, Merger, Splitter, TokenizerFile, groups

LIMIT = 1024


class Counter:
    """Counts a worker's texts; the counts of pre-tokens that were met are kept between batches."""

    def __init__(self, path: str):
        file = TokenizerFile(path)
        self.split, self.merger, self.specials = Splitter(file.specials), Merger(file), dict.fromkeys(file.specials, 1)
        self.known: dict[str, int] = dict(self.specials)

    def __call__(self, texts: Iterable[str]) -> Iterator[int]:
        for group in groups(texts):
            split = [self.split(t) for t in group]
            if len(self.known) > KNOWN_MOST:
                self.known = dict(self.specials)
            if new := list(set().union(*split).difference(self.known)):
                self.known.update(zip(new, self.merger.counts([t.encode() for t in new]).tolist(), strict=True))
            known = self.known.__getitem__
            yield from (sum(map(known, t)) for t in split)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each worker process and tokenizer."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = counter(path)
    for b in batches:
        n = list(count(x.as_py() for x in b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row. Null texts count as empty, which have no tokens; a null doc_id stays
    null; repeated rows each get a row; an empty table gives an empty result; further columns are ignored. A special token's
    string inside a text is that token, as the library has it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(whole()).cast("long").alias("n_bytes"), whole().alias("text"))
    counted = rows.mapInArrow(partial(_count, path=path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
