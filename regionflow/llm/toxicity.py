"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, Isotonic
from .common import held_out, whole

#: Labelled rows learned from at most, taken by the smallest hash of doc_id; and how many of them give words to the lexicon.
LEARN_MOST, WORDS_FROM = 16_000, 4_000
#: A learned word is in so many toxic texts at least, and has at least this share of toxic ones among its texts. So many texts bound the words.
WORD_TEXTS, WORD_SHARE = 8, 0.6
#: Words between an insult and a second person that still count as near; characters handled at a time, up to the next white space.
NEAR, WINDOW = 6, 1 << 20
THRESHOLD = 0.3
#: Fixed words.
INSULTS = frozenset(
    "arschloch asshole bastard bitch bollocks cabron clown coward cretin crap damn depp disgusting dumb dumbass estupido fool freak fuck garbage idiot idiota "
    "idioten imbecile imbecil jerk kill liar loser moron nazi pathetic pendejo pig prick puta rubbish salaud scum scumbag shit sick slut stupid "
    "stupide trash trottel twat ugly vermin whore worthless wanker connard dummkopf".split()
)
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split())
#: Characters that stand for letters in disguised words.
LEET = str.maketrans("013457@$!|", "oieastasil")
WORD = re.compile(r"[^\W\d_]+(?:[0134579@$!|*]+[^\W\d_]+)*")
BLANK = re.compile(r"\s")
DISGUISED = re.compile(r"[0134579@$!|*]")
FEATURES = 14


def windows(text: str) -> Iterator[str]:
    """A text in stretches; only white space is cut at, so that no word is parted."""
    at = 0
    while len(text) - at > WINDOW and (m := BLANK.search(text, at + WINDOW)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


class Seen:
    """What the windows of a text hold: sums, and the places of hits and of second persons, counted in words from the text's start."""

    def __init__(self, lexicon: frozenset[str]):
        self.lexicon, self.sums, self.words, self.places = lexicon, np.zeros(5), 0, ([], [], [])
        self.kinds: set[str] = set()
        self.odd: dict[str, int] = {}  # disguised words, and how often each is there

    def add(self, text: str) -> None:
        words = WORD.findall(text.lower())
        present = set(words)
        by = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        self.sums += (by[65:91].sum(), by[97:123].sum() + by[192:].sum(), by[33], by[63], by[35:48].sum() + by[91:97].sum() + by[58:65].sum())
        for listed, places in zip((INSULTS, self.lexicon, YOU), self.places, strict=True):
            if not present.isdisjoint(listed):
                places += [self.words + k for k, w in enumerate(words) if w in listed]
        self.kinds |= present & (INSULTS | self.lexicon)
        for w in present:
            if DISGUISED.search(w):
                self.odd[w] = self.odd.get(w, 0) + words.count(w)
        self.words += len(words)

    def features(self) -> np.ndarray:
        upper, lower, bang, ask, marks = self.sums
        insults, learned, you = (np.array(p, np.int64) for p in self.places)
        hits = np.union1d(insults, learned)
        near = (np.searchsorted(you, hits + NEAR, "right") > np.searchsorted(you, hits - NEAR, "left")).sum()
        plain = {w: DISGUISED.sub("", w.translate(LEET)) for w in self.odd}
        hidden = sum(self.odd[w] for w, p in plain.items() if p in INSULTS or p in self.lexicon)
        n, letters = max(self.words, 1), max(upper + lower, 1.0)
        logs = np.log1p([len(insults), len(learned), len(self.kinds), near])
        return np.array([len(insults) / n, len(learned) / n, *logs, len(you) / n, upper / letters, bang / n, ask / n, marks / n, len(self.odd) / n, np.log1p(hidden), np.log1p(self.words)])


def features(text: str | None, lexicon: frozenset[str] = frozenset()) -> np.ndarray:
    """Dense features of a whole text: rates by word or letter, and logarithms of counts. Null and empty texts give zeros."""
    seen = Seen(lexicon)
    for part in windows(text or ""):
        seen.add(part)
    return seen.features()


@dataclass
class Model:
    lexicon: frozenset[str]
    trees: Boosted
    scale: Isotonic

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        x = [features(t, self.lexicon) for t in texts]
        return np.clip(self.scale(self.trees.margin(np.array(x).reshape(-1, FEATURES))), 0.0, 1.0)


def _features(parts: Iterator[pd.DataFrame], lexicon: frozenset[str]) -> Iterator[pd.DataFrame]:
    for p in parts:
        yield pd.DataFrame({"doc_id": p["doc_id"], "toxic": p["toxic"], "x": [features(t, lexicon).tolist() for t in p["text"]]})


def _words(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts and toxic texts of each word, summed for the partition."""
    total: dict[str, list[int]] = {}
    for p in parts:
        for text, toxic in zip(p["text"], p["toxic"], strict=True):
            for w in set(WORD.findall((text or "").lower())):
                n = total.setdefault(w, [0, 0])
                n[0] += 1
                n[1] += int(toxic)
    yield pd.DataFrame({"word": pd.Series(list(total), dtype=object), "n": pd.Series([n[0] for n in total.values()], dtype="int64"), "bad": pd.Series([n[1] for n in total.values()], dtype="int64")})


def learn(docs: DataFrame, labels: DataFrame, most: int = LEARN_MOST) -> Model:
    """A model from at most ``most`` labelled rows that aren't held out. Where a document has several labels, any toxic one counts.
    Trees learn from three quarters of them and are calibrated on the rest. With one class only, or none, the score is its share."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most ``most`` rows are broadcast; of rows that share a doc_id one text is learned from
    of = lambda ids: docs.select("doc_id", whole().alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    rows, some = of(chosen), of(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(min(most, WORDS_FROM)))
    # every word of every partition is counted, so that shares don't depend on how rows are dealt out
    found = some.select("text", "toxic").mapInPandas(_words, "word string, n long, bad long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    found = found.where((F.col("bad") >= WORD_TEXTS) & (F.col("bad") >= WORD_SHARE * F.col("n")))
    lexicon = frozenset(r["word"] for r in found.collect())
    data = rows.select("doc_id", "toxic", "text").mapInPandas(partial(_features, lexicon=lexicon), "doc_id long, toxic int, x array<double>").orderBy("doc_id").toPandas()
    if not len(data):
        return Model(lexicon, Boosted(), Isotonic())
    x, y = np.array(data["x"].tolist()), data["toxic"].to_numpy(float)
    rest = np.array([zlib.crc32(f"calibrate {d}".encode()) % 4 == 0 for d in data["doc_id"]])
    if y[~rest].min(initial=1) == y[~rest].max(initial=0) or not rest.any():
        return Model(lexicon, Boosted(), Isotonic(np.zeros(1), np.array([y.mean()])))
    trees = Boosted().fit(x[~rest], y[~rest])
    return Model(lexicon, trees, Isotonic().fit(trees.margin(x[rest]), y[rest]))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        scores = pa.array(model.score(x.as_py() for x in b.column("text")), pa.float64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), scores], ["doc_id", "held_out", "score"])


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. Null texts count as empty and get the score of a text without words. A null
    doc_id counts as held out. Repeated rows each get a row; an empty table gives an empty result; further columns are ignored. Only
    the text counts in a score."""
    model = learn(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), whole().alias("text"))
    scored = rows.mapInArrow(partial(_score, model=model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
