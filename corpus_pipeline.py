"""The corpus pipeline: language ID, exact dedup, near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from regionflow.llm import exact_dedup, language, packing, secrets, simhash
from regionflow.llm.common import in_few_files, read, settle, small_batches

#: Words of a shingle where no contract sets another number, and the tokenizer that packing uses.
SHINGLE_WORDS = 5
TOKENIZER = "byte_bpe_50k.json"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language, or unlike all learned ones; learns from those that aren't held out."""
    return in_few_files(language.drop_rejected(small_batches(docs)))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return in_few_files(exact_dedup.drop_copies(small_batches(docs)))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies: those that SimHash's index links, verified by their shingles, and the alike ones
    that more bits part."""
    return in_few_files(simhash.drop_near_duplicates(small_batches(docs), SHINGLE_WORDS))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; every document stays."""
    return in_few_files(secrets.redact(small_batches(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    return in_few_files(packing.pack(small_batches(docs), public_tokenizers.path(TOKENIZER)))


STAGES = [("language", language_stage), ("exact", exact_stage), ("near", near_stage), ("secrets", secret_stage), ("packing", packing_stage)]

#: SQL can express neither learned languages nor XXH64, so tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
