"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that exact dedup deletes and that separate words: fixed by the contracts.
BLANK = r"[\x20\x09-\x0D]"


#: Rows that Spark's Parquet reader decodes at a time, and rows and bytes that are handed to Python at a time: whole texts are long, and a
#: batch is held in memory more than once.
READER_ROWS, ARROW_ROWS, ARROW_BYTES = 256, 1000, 16 << 20


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs`` in a session of their own, which is as the caller's except that it handles few rows at a time. The caller's stays as it is."""
    spark = docs.sparkSession
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for name, value in (("parquet.columnarReaderBatchSize", READER_ROWS), ("execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        own.conf.set(f"spark.sql.{name}", value)
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, docs._jdf.queryExecution().analyzed())
    return DataFrame(rows, own)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the corpus, by a path that any of Spark's readers can open."""
    return small_batches(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


#: A settled table has at most so many files for each core, unless they would grow beyond so many bytes of input.
FILES_PER_CORE, FILE_BYTES = 4, 64 << 20


def in_few_files(df: DataFrame) -> DataFrame:
    """``df`` in at most so many partitions that each core has several, or that each reads ``FILE_BYTES``: what is written is no crowd of small files."""
    read = sum(int(str(leaf.stats().sizeInBytes())) for leaf in _files(df))
    return df.coalesce(max(FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, read // FILE_BYTES))


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder that the session names, so that a lost executor costs no recomputation of long
    texts. A folder of our own is set only where the session names none and all tasks run in the driver's process. Many small partitions are written as fewer files."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="regionflow-"))
    # constraints that a checkpoint takes along name columns it no longer has; a later self-join fails on them
    conf, name = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return in_few_files(df).checkpoint()
    finally:
        conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Has the driver look for tables that nothing refers to any more, so that Spark's cleaner removes their shuffles and checkpoints now and not
    at the next chance: a job of many steps else holds the files of all of them."""
    spark.sparkContext._jvm.System.gc()


#: Rows that are looked up by broadcast at most, where they are short; more are joined by a shuffle.
LOOKED_UP_MOST = 500_000
#: Groups that each hold more than the inverse share of all rows. There are fewer of them than this, or their rows would be more than all.
HOT_MOST = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str | None = None, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` has one row for each key, and may have the number of its rows. Groups with
    more than a ``HOT_MOST``-th of all rows are broadcast, so that no key sends more than that to one task. ``rows`` are read more than once."""
    n = rows.count()
    if size is None:
        sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        hot = F.broadcast(sizes.where(F.col("n") * HOT_MOST > n).select(key))
        large = F.broadcast(groups.join(hot, key, "left_semi"))
    else:
        large = F.broadcast(groups.where(F.col(size) * HOT_MOST > n))
        hot = F.broadcast(large.select(key))
    of_large = rows.join(hot, key, "left_semi").join(large, key, how)
    return of_large.unionByName(rows.join(hot, key, "left_anti").join(groups, key, how))


def never_broadcast(side: DataFrame) -> DataFrame:
    """A side of a join of which neither is broadcast, whatever their sizes. Spark takes what explode makes for as many rows as went in, and would
    send all postings of a short table to the driver."""
    return side.hint("merge")


def unused(df: DataFrame, n: int) -> list[str]:
    """Names that no column of ``df`` has."""
    longest = max(map(len, df.columns), default=0)
    return ["_" * (longest + 1 + k) for k in range(n)]


def _files(df: DataFrame) -> list:
    """The plan's leaves that read files; what was settled before is small against them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [x for x in (leaves.apply(i) for i in range(leaves.size())) if x.getClass().getSimpleName() == "LogicalRelation"]


def whole(text: str | Column = "text") -> Column:
    """A text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row belongs to the fold that nothing is learned from. Null ids belong to it."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def shuffle_width(spark: SparkSession) -> int:
    """How many ways to deal out rows; follows the session, which a cluster sizes to its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
