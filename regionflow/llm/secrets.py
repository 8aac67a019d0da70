"""Secret scans by an incremental blob ledger.

Every historical version of a file is known by the SHA-256 of its content. The ledger has one row for each blob and rule version
that was ever scanned; only pairs it lacks are scanned, once however many paths and versions share the blob, and findings are
joined back to all of them. The ledger can be kept as a table that each scan adds to. A rule version is the digest of the rules, so that
changed rules never reuse old findings. Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_groups, settle, unused, whole


@dataclass(frozen=True)
class Rule:
    """Matches of ``find`` are taken leftmost first, without overlap; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    find: str
    group: int
    least: int


#: Fixed by the contract; the order is that of kinds. A run's maximal match of 16 or 14 more characters is the match of ``+`` that passes.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Dirty blobs with their spans that are looked up by broadcast at most; more are joined by a shuffle.
LOOKED_UP_MOST = 100_000
LEDGER = "blob string, rule_version string, spans array<struct<start:int,rank:int,kind:string,end:int>>"


def version_of(rules: Sequence[Rule]) -> str:
    return hashlib.sha256(repr([astuple(r) for r in rules]).encode()).hexdigest()[:16]


def blob_id(text: str | Column = "text") -> Column:
    return F.sha2(whole(text), 256)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {c.split(' ', 1)[1]}) AS {c.split(' ', 1)[0]}" for c in LEDGER.split(", ")) + " WHERE false")


def _pieces(rank: int, rule: Rule, found: Column) -> Column:
    """For each match the length of the gap before it, its own length, and whether it passes."""
    text = F.col("text")
    gaps = F.transform(F.split(text, rule.find, -1), lambda x: F.length(x))
    measured = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.find), F.lit(rule.group))
    zipped = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"), measured.alias("part"), F.sequence(F.lit(1), F.size(found)).alias("nth")),
        lambda x: F.struct(F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), x["nth"].alias("nth"), x["gap"].alias("gap"), F.length(x["hit"]).alias("len"), (F.length(x["part"]) >= rule.least).alias("ok")),
    )
    return F.when(F.size(found) > 0, zipped)


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """New ledger rows for blobs (blob, text). Positions are code points; ``end`` is exclusive."""
    hits = blobs.select("blob", "text", *[F.regexp_extract_all("text", F.lit(r.find), F.lit(0)).alias(f"hit{k}") for k, r in enumerate(rules)])
    parts = [F.coalesce(_pieces(k, r, F.col(f"hit{k}")), F.expr("CAST(array() AS array<struct<rank:int,kind:string,nth:int,gap:int,len:int,ok:boolean>>)")) for k, r in enumerate(rules)]
    rows = hits.select("blob", F.explode_outer(F.concat(*parts)).alias("p")).select("blob", "p.*")
    till = W.partitionBy("blob", "rank").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(till).cast("int"))
    span = F.struct((F.col("end") - F.col("len")).alias("start"), "rank", "kind", "end")
    return placed.groupBy("blob").agg(F.array_sort(F.collect_list(F.when(F.col("ok"), span))).alias("spans")).select("blob", F.lit(version_of(rules)).alias("rule_version"), "spans")


def extend_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """Ledger rows for the (blob, rule version) pairs of ``versions`` that ``ledger`` lacks; each blob's text moves once."""
    unseen = versions.select(blob_id(text_col).alias("blob"), whole(text_col).alias("text"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rule_version") == version_of(rules)).select("blob"), "blob", "left_anti")
    return scan_blobs(unseen.groupBy("blob").agg(F.first("text").alias("text")), rules)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger kept at ``path``, in any store that Spark reads; empty where there is none yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(LEDGER).parquet(path) if there else empty_ledger(spark)


def update_ledger(versions: DataFrame, path: str, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """Scans what the ledger at ``path`` lacks, adds it there, and gives the whole ledger. Blobs that it has are not read again."""
    spark = versions.sparkSession
    extend_ledger(versions, read_ledger(spark, path), rules, text_col).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def findings(versions: DataFrame, ledger: DataFrame, keys: Sequence[str], rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """``keys`` of every row of ``versions`` with the spans of its blob; clean rows have an empty list."""
    dirty = ledger.where((F.col("rule_version") == version_of(rules)) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    paths = settle(versions.select(*keys, blob_id(text_col).alias("blob")))
    found = join_groups(paths, dirty, "blob", how="left")
    return found.select(*keys, "blob", F.coalesce("spans", F.expr("CAST(array() AS array<struct<start:int,rank:int,kind:string,end:int>>)")).alias("spans"))


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """doc_id, blob and spans of every row. Null texts count as empty and have no spans; repeated rows each get a row; an empty
    table gives an empty result; further columns are ignored. What ``ledger`` has isn't scanned again."""
    new = settle(extend_ledger(docs, ledger))
    return findings(docs, new if ledger is None else ledger.unionByName(new), ["doc_id"])


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns: counts by kind, and the spans as text with their SHA-256."""
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *[count(r.kind) for r in RULES], F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans are replaced together. Clean rows stay as they are."""
    blob, sha, spans, parts = unused(docs, 4)
    scanned = settle(extend_ledger(docs).where(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(spans)))
    scanned = F.broadcast(scanned) if scanned.count() <= LOOKED_UP_MOST else scanned
    joined = docs.withColumn(sha, blob_id()).join(scanned, F.col(sha) == F.col(blob), "left")
    merged = F.aggregate(
        spans, F.expr("CAST(array() AS array<struct<start:int,end:int>>)"),
        lambda got, s: F.when((F.size(got) > 0) & (s["start"] <= F.element_at(got, -1)["end"]), F.concat(F.slice(got, 1, F.size(got) - 1), F.array(F.struct(F.element_at(got, -1)["start"].alias("start"), F.greatest(F.element_at(got, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(got, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    starts = F.concat(F.array(F.lit(0)), F.transform(parts, lambda s: s["end"]))
    ends = F.concat(F.transform(parts, lambda s: s["start"]), F.array(F.length("text")))
    kept = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.substring(F.col("text"), x["a"] + 1, x["b"] - x["a"]))
    out = joined.withColumn(parts, merged).withColumn("text", F.when(F.col(blob).isNotNull(), F.array_join(kept, mark)).otherwise(F.col("text")))
    return out.select(*docs.columns)
