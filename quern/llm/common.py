"""What the training-data operators share: their tables, working folders and ranges of ids."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks between words, as a regular expression's class.
BLANKS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; set here only where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        found = spark.sparkContext.getCheckpointDir()
        at = found or tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: their lineage ends there."""
    spark = df.sparkSession
    at = new_folder(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def released(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same work, after which a worker gives back what it has freed: it waits for other stages beside their workers."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another system's library keeps its own account
            pass

    return run


def words(text: Column) -> Column:
    """Array of the maximal runs of other characters than blanks; null and blank texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition on computed columns.

    The optimizer would copy their expressions below the filter, each as often as it is named; beside a column that is
    not deterministic it leaves them where they are.
    """
    d = df.withColumn("__at", F.monotonically_increasing_id())
    return d.where(condition & (F.col("__at") >= 0)).drop("__at")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_starts(df: DataFrame, key: str, n: int) -> list:
    """At most ``n`` ascending values of ``key`` that cut the rows into about equal ranges; the first is its least.

    The driver gets ``n`` numbers, however many rows there are.
    """
    n = max(1, n)
    cuts = [i / n for i in range(n)]
    found = df.select(
        F.min(key).alias("least"), F.percentile_approx(key, cuts, max(10_000, 20 * n)).alias("cuts")
    ).first()
    return [] if found["least"] is None else sorted({found["least"], *found["cuts"]})


def range_number(key: Column, starts: list) -> Column:
    """Which of the ranges that begin at ``starts`` a value lies in, from 0 (also for null): two short searches."""
    if not starts:
        return F.lit(0)
    step = math.isqrt(len(starts) - 1) + 1
    groups = [starts[i : i + step] for i in range(0, len(starts), step)]
    groups_of = F.array(*[F.array(*map(F.lit, g)) for g in groups])
    coarse = F.greatest(F.size(F.filter(F.array(*[F.lit(g[0]) for g in groups]), lambda x: x <= key)), F.lit(1))
    fine = F.size(F.filter(F.element_at(groups_of, coarse), lambda x: x <= key))
    return F.greatest((coarse - 1) * step + fine - 1, F.lit(0))
