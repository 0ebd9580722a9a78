"""The corpus pipeline: documents through quality rules, near-dedup, substring dedup, mixing and packing.

Every stage gets all that the one before it kept, written as Parquet in the shared folder and read again.  Null and empty
texts, repeated rows and empty tables pass through every stage; rows with a null doc_id are judged by themselves and kept.
Documents are some kilobytes each, so the stages that use Python ask for batches of ``BATCH`` rows, unless the session
has a number of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common, mixing, neardup, packing, quality_rules, queries, substrings


#: Rows of a batch that goes to a Python worker, and Spark's own number.
BATCH, DEFAULT = 1000, "10000"
#: Ids of pieces that a worker keeps while it packs: workers of the stages before it may be alive beside it.
REMEMBERED = 4_000_000


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == DEFAULT:
        spark.conf.set(name, str(BATCH))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base check nor a learned rule rejects."""
    judged = quality_rules.judged(docs, common.table(spark, sf_dir, "labels"))
    return common.where_computed(judged, F.col("kept")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8): that of the smallest doc_id."""
    small_batches(spark)
    return neardup.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; n_chars is that of the text left."""
    small_batches(spark)
    d = substrings.cut(docs, staged=True)
    return d.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens are raked to smoothed shares of source, language and topic."""
    small_batches(spark)
    return mixing.sampled(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    small_batches(spark)
    return packing.packed(docs, queries.tokenizer("word_bpe_49k.json"), remembered=REMEMBERED)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: MinHash tables, de Bruijn paths, raking and packing have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
