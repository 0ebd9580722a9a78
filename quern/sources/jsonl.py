"""JSON lines and plain lines: strict and lenient reading, versioned documents, upserts of tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# What a wrong decoding left of a dagger, and signs for a hyphen.
DAGGER = "â€\u00a0"
HYPHENS = "\u2010\u2011"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; set here only where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:  # a session of one machine, as in tests
        at = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder, for what is read more than once."""
    at = new_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def write(df: DataFrame, at: str) -> None:
    df.write.json(at)


def read(spark: SparkSession, at: str, schema: StructType | str) -> DataFrame:
    """Rows of the schema; a line that does not fit it ends the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(at)


def lines(spark: SparkSession, at: str) -> DataFrame:
    """Lines (value) of text files with their file, the place where their piece of it begins (block), and ``id``, ascending in a piece."""
    return spark.read.text(at).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")
    )


def strict(spark: SparkSession, at: str, schema: str) -> DataFrame:
    """Rows of the schema with ``file`` and ``line`` (its number, from 1); blank lines count, but are no rows.

    A line that is no JSON object of the schema ends the query with its number, a folder without rows is refused.
    """
    from quern.operators import ordered  # it needs tables of this module

    d = ordered.numbered_files(lines(spark, at), "line").where(F.trim("value") != "")
    if d.isEmpty():
        raise ValueError(f"no lines in {at}")
    parsed = F.from_json("value", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    d = d.withColumn("__row", parsed)
    wrong = F.col("__row").isNull() | F.col("__row.__bad").isNotNull() | ~F.ltrim("value").startswith("{")
    fault = F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" of "), F.col("file"), F.lit(" is not valid"))).cast("string")
    names = [f.split()[0] for f in schema.split(", ")]
    return d.select(*[f"__row.{n}" for n in names], F.when(wrong, fault).otherwise(F.col("file")).alias("file"), "line")


#: Version of batches that is read.
BATCH = "batch-v1"


def batches(spark: SparkSession, at: str, schema: str) -> DataFrame:
    """Entries of all good batches: lines with batch_id, format_version and a locator.

    A batch may have any number of lines, in any files.  One of another version on any line, or with a locator that is
    null or stands twice, is refused whole; locators are counted batch by batch, in parts.
    """
    rows = read(spark, at, f"{schema}, format_version string")
    wrong = F.coalesce(F.col("format_version") != BATCH, F.lit(True)) | F.col("locator").isNull()
    seen = rows.groupBy("batch_id", "locator").agg(F.count("*").alias("n"), F.max(wrong).alias("wrong"))
    bad = seen.groupBy("batch_id").agg(F.max(F.col("wrong") | (F.col("n") > 1)).alias("bad")).where("bad").select("batch_id")
    return rows.where("batch_id IS NOT NULL").join(bad, "batch_id", "left_anti")


def lenient(spark: SparkSession, at: str, schema: str) -> DataFrame:
    """Rows of the schema, with lines that do not fit it in the column ``bad``."""
    return spark.read.schema(f"{schema}, bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(at)


def numbered_lines(text, name: str = "line"):
    """Array of (number, line) of a text, from 1."""
    return F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("number"), x.alias(name)))


def cleaned_line(x):
    """A line with its daggers put right, soft hyphens gone, two kinds of hyphen made one, and no white space round it."""
    x = F.replace(F.replace(x, F.lit(DAGGER), F.lit("†")), F.lit("\u00ad"), F.lit(""))
    return F.regexp_replace(F.translate(x, HYPHENS, "-" * len(HYPHENS)), r"(?U)^\s+|\s+$", "")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` laid over it by a natural key: replaced where known, added where not."""
    columns = [c for c in old.columns if c != key]
    o = old.select(key, *[F.col(c).alias(f"__o_{c}") for c in columns])
    n = new.select(key, F.lit(True).alias("__new"), *[F.col(c).alias(f"__n_{c}") for c in columns])
    pick = [F.when(F.col("__new"), F.col(f"__n_{c}")).otherwise(F.col(f"__o_{c}")).alias(c) for c in columns]
    return o.join(n, key, "full").select(key, *pick)
