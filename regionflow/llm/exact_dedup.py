"""Exact dedup by content-defined chunk recipes.

Each normalised text is cut where its own content says so, and is then known by its recipe: the ordered list of its chunks'
identifiers. Chunks are deduplicated to identifiers that are verified by SHA-256; documents are compared by their recipes, so a
long text is read once and never shuffled. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, LOOKED_UP_MOST, join_groups, settle, unused, whole

#: Code points a chunk has at least (but for a text's last chunk) and at most.
CHUNK_LEAST, CHUNK_MOST = 512, 4096
#: A chunk ends behind one of these; in a text without them behind one of the others, which are rare in many scripts; or at its greatest length.
CUT_BEHIND, ELSE_BEHIND = r"[.!?;:|।。！？]", r"[0-9jqxzJQXZßñёэщьالظغ的了是のはを이는다]"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(whole(text), f"{BLANK}+", "")


def chunks(text: Column, least: int = CHUNK_LEAST, most: int = CHUNK_MOST) -> Column:
    """The chunks of a text in order; joined they give the text. An empty text has none."""
    behind = (f".{{{least},{most - 1}}}?{c}" for c in (CUT_BEHIND, ELSE_BEHIND))
    return F.regexp_extract_all(text, F.lit(f"(?s)(?:{'|'.join(behind)}|.{{1,{most}}})"), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: uid, id, code points of the original text, SHA-256 of the normalised text, and the recipe as
    parallel lists of 64-bit identifiers and SHA-256 digests."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.length(whole(text_col)).alias("n_points"), normalised(text_col).alias("norm"))
    cut = text.select("doc_id", "n_points", F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm")).alias("cut"))
    return cut.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "n_points", "text_sha256",
        F.transform("cut", lambda c: F.xxhash64(c)).alias("ids"),
        F.transform("cut", lambda c: F.unhex(F.sha2(c, 256))).alias("digests"),
    )


def chunk_store(recipe_rows: DataFrame) -> DataFrame:
    """Every distinct chunk once: identifier and digest. Copies of a chunk are combined before the shuffle."""
    pairs = recipe_rows.select(F.explode(F.arrays_zip("ids", "digests")).alias("c"))
    return pairs.select(F.col("c.ids").alias("chunk_id"), F.col("c.digests").alias("digest")).distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decide for every row of ``docs`` whether it stays.

    Returns uid, doc_id, keep_id, group_size, kept, text_sha256, n_chunks. Of equal texts the row with the most code points in
    the original text stays, then the smallest doc_id; of repeated rows of one doc_id exactly one. Null texts count as empty,
    and empty texts are equal to each other; a null doc_id comes behind all others. An empty table gives an empty result.
    Further columns of ``docs`` are ignored.

    Should two different chunks ever share an identifier, identifiers are widened to whole digests for all documents.
    """
    rows = settle(recipes(docs, id_col, text_col))
    clash = chunk_store(rows).groupBy("chunk_id").count().where("count > 1")
    recipe = F.col("ids") if clash.isEmpty() else F.col("digests")
    rows = rows.select("uid", "doc_id", "n_points", "text_sha256", F.size("ids").alias("n_chunks"), recipe.alias("recipe"))
    best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("minus_id"), (-F.col("uid")).alias("minus_uid")))
    groups = settle(rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")))
    return join_groups(rows, groups, "recipe", "group_size").select(
        "uid", "doc_id", (-F.col("best.minus_id")).alias("keep_id"), "group_size",
        (F.col("uid") == -F.col("best.minus_uid")).alias("kept"), "text_sha256", "n_chunks",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. Rows are told apart by doc_id, and where one stands before several rows by the
    digest of the text too: each of its texts is decided on by itself, and of the same text before the same doc_id one row is kept."""
    found = settle(exact_dedup(docs).select("doc_id", "text_sha256", "kept", "group_size"))
    gone = settle(found.where("group_size > 1").groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 OR NOT kept"))
    small = F.broadcast if gone.count() <= LOOKED_UP_MOST else (lambda df: df)
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        lost = gone.select(F.col("doc_id").alias("lost"))
        return docs.join(small(lost), F.col("doc_id").eqNullSafe(F.col("lost")), "left_anti").select(*docs.columns)
    sha, points, lost, lost_sha = unused(docs, 4)
    marked = docs.withColumn(sha, F.sha2(normalised(), 256)).withColumn(points, F.length(whole()))
    by = lambda df: small(df.select(F.col("doc_id").alias(lost), F.col("text_sha256").alias(lost_sha)))
    same = F.col("doc_id").eqNullSafe(F.col(lost)) & (F.col(sha) == F.col(lost_sha))
    single = marked.join(by(gone), same, "left_anti").select(*docs.columns)
    again = marked.join(by(gone.where("kept")), same, "left_semi")
    best = again.groupBy(F.col("doc_id").alias(lost), F.col(sha).alias(lost_sha)).agg(F.max(points).alias("most"))
    longest = again.join(best.withColumnRenamed("most", (most := unused(docs, 5)[4])), same & (F.col(points) == F.col(most)))
    return single.unionByName(longest.dropDuplicates(["doc_id", sha]).select(*docs.columns))
