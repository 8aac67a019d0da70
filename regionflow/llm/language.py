"""Language ID with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A trigram's vector binds its letters' vectors, permuted by their
place, by multiplication; a text's vector bundles its trigrams by addition, a language's those of its learned texts at length one; texts
are compared with languages by cosine. Texts are bundled many at a time: their trigrams' counts, one row a text, times the trigrams' vectors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .pretokens import groups

#: Components of a vector, characters that are handled at a time, and trigrams and texts that are bundled at a time.
DIMENSIONS, WINDOW, TRIGRAMS, TEXTS = 4096, 1 << 20, 1024, 256
#: Learned rows at most, taken by the smallest hash of doc_id; and the seed of letter vectors.
LEARN_MOST, SEED = 12_000, 20240229
#: The pipeline rejects texts whose best cosine is lower.
REJECT_BELOW = 0.04
NONE = "und"
#: Bits of a code point.
BITS = 21


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def codes(text: str) -> Iterator[np.ndarray]:
    """Trigram codes of a text, window by window. Runs of other characters count as one; trigrams have a letter in the middle."""
    low = text.lower()
    tail = np.zeros(1, np.int64)
    for at in range(0, len(low), WINDOW):
        c = np.frombuffer(low[at : at + WINDOW].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        c = np.where(_is_letter()[c], c, 0)
        c = np.r_[tail, c, 0] if at + WINDOW >= len(low) else np.r_[tail, c]
        c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]
        tri = (c[:-2] << 2 * BITS) | (c[1:-1] << BITS) | c[2:]
        yield tri[c[1:-1] != 0]
        tail = c[-2:]


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams and their counts."""
    parts = [np.unique(t, return_counts=True) for t in codes(text)]
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return found, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """Of each code point, +1 and -1 by the bits of a mixed counter."""
    with np.errstate(over="ignore"):
        x = letters.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS // 64) + np.arange(DIMENSIONS // 64, dtype=np.uint64) + np.uint64(SEED)
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)  # the published finaliser of SplitMix64
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.unpackbits(x.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def ngram_vectors(trigrams: np.ndarray) -> np.ndarray:
    """Bound vectors: each letter's vector is rotated by its place, then they are multiplied."""
    places = [trigrams >> 2 * BITS, trigrams >> BITS & (1 << BITS) - 1, trigrams & (1 << BITS) - 1]
    letters, at = np.unique(np.concatenate(places), return_inverse=True)
    vectors, at = letter_vectors(letters), at.reshape(3, -1)
    return np.roll(vectors, 2, 1)[at[0]] * np.roll(vectors, 1, 1)[at[1]] * vectors[at[2]]


def bundles(counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The bundled vector of each text."""
    out = np.zeros((len(counts), DIMENSIONS), np.float64)
    seen, at = np.unique(np.concatenate([np.empty(0, np.int64), *(k for k, _ in counts)]), return_inverse=True)
    row = np.repeat(np.arange(len(counts)), [len(k) for k, _ in counts])
    n = np.concatenate([np.empty(0, np.int64), *(n for _, n in counts)])
    order = np.argsort(at, kind="stable")
    row, at, n = row[order], at[order], n[order]
    for first in range(0, len(seen), TRIGRAMS):
        own = slice(*np.searchsorted(at, [first, first + TRIGRAMS]))
        block = np.zeros((len(counts), min(TRIGRAMS, len(seen) - first)), np.float32)
        block[row[own], at[own] - first] = n[own]
        out += block @ ngram_vectors(seen[first : first + TRIGRAMS]).astype(np.float32)
    return out


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True).clip(1e-12)


@dataclass
class Profiles:
    languages: list[str]
    prototypes: np.ndarray  # one row a language, of length one

    def predict(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float]]:
        """Each text's language and the cosine with its prototype, from 0 to 1. Ties go to the first language by name."""
        for group in groups(t or "" for t in texts):
            for at in range(0, len(group), TEXTS):
                counts = [counted(t) for t in group[at : at + TEXTS]]
                if not self.languages:
                    yield from ((NONE, 0.0) for _ in counts)
                    continue
                cosines = units(bundles(counts)) @ self.prototypes.T
                for (k, _), c in zip(counts, cosines, strict=True):
                    best = int(np.argmax(c))
                    yield (self.languages[best], float(min(1.0, max(0.0, c[best])))) if len(k) else (NONE, 0.0)


def _sum_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sum of the texts' vectors by language, each at length one."""
    sums: dict[str, np.ndarray] = {}
    for p in parts:
        for at in range(0, len(p), TEXTS):
            some = p.iloc[at : at + TEXTS]
            vectors = units(bundles([counted(t) for t in some["text"]]))
            for lang, rows in some.reset_index(drop=True).groupby("lang").groups.items():
                sums[lang] = sums.get(lang, 0) + vectors[rows].sum(0)
    for lang, s in sums.items():
        yield pd.DataFrame({"lang": lang, "place": np.arange(DIMENSIONS), "value": s})


def learn(docs: DataFrame, most: int = LEARN_MOST) -> Profiles:
    """Profiles from text and lang of at most ``most`` rows that are not held out and have both; the driver gets one vector for each
    language."""
    fit = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    chosen = fit.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = fit.join(F.broadcast(chosen), "doc_id").select("lang", "text")  # at most ``most`` ids are broadcast
    # rounded, so that the order in which partitions are added doesn't count
    total = F.round(F.sum("value"), 6).alias("value")
    sums = rows.mapInPandas(_sum_up, "lang string, place int, value double").groupBy("lang", "place").agg(total).toPandas()
    wide = sums.pivot(index="lang", columns="place", values="value").sort_index()
    wide = wide[(wide != 0).any(axis=1)]
    return Profiles(list(wide.index), units(wide.to_numpy(float).reshape(len(wide), DIMENSIONS if len(wide) else 0)))


def _predict(batches: Iterator[pa.RecordBatch], profiles: Profiles) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = list(profiles.predict(x.as_py() for x in b.column("text")))
        added = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *added], ["doc_id", "held_out", "lang_pred", "score"])


def predict(docs: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row. Null texts and texts without a letter are ``und`` with score 0, as are all
    when nothing could be learned. A null doc_id counts as held out. Repeated rows each get a row; an empty table gives an empty
    result; further columns are ignored. Only the text counts in a prediction."""
    profiles = learn(docs) if profiles is None else profiles
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text"))
    return rows.mapInArrow(partial(_predict, profiles=profiles), "doc_id long, held_out boolean, lang_pred string, score double")


def _accept(parts: Iterator[pa.RecordBatch], profiles: Profiles, below: float) -> Iterator[pa.RecordBatch]:
    for b in parts:
        yield b.filter(pa.array([lang != NONE and score >= below for lang, score in profiles.predict(x.as_py() for x in b.column("text"))], pa.bool_()))


def drop_rejected(docs: DataFrame, below: float = REJECT_BELOW) -> DataFrame:
    """``docs`` without texts that have no language or resemble none of the learned ones; their columns stay as they are."""
    return docs.mapInArrow(partial(_accept, profiles=learn(docs), below=below), docs.schema)
