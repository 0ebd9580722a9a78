"""Idempotent ingestion: files of a landing folder become a table in which each key occurs once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def run(spark: SparkSession, landing: str, schema: StructType, key: str, table: str, state: str, buckets: int = 32) -> None:
    """Ingests all that has landed since the last run and stops; the checkpoint below ``state`` remembers files alone.

    The stream keeps no state.  Keys that earlier batches brought are an index below the table, in buckets of keys: a batch
    is held against it by an anti-join that reads the buckets in place, so a late duplicate is refused however late it
    comes.  A batch that is run again overwrites its own rows, and its own keys do not count against it.  Rows with a null
    key are all kept.
    """
    name = f"ingested_{uuid.uuid4().hex}"
    kind = schema[key].dataType.simpleString()
    spark.sql(f"CREATE TABLE {name} (`{key}` {kind}, batch BIGINT) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{table}/keys'")

    def step(batch: DataFrame, number: int) -> None:
        before = spark.table(name).where(F.col("batch") < number).select(key)
        rows = batch.where(F.col(key).isNotNull()).dropDuplicates([key]).join(before, key, "left_anti").unionByName(batch.where(F.col(key).isNull()))
        at = f"{table}/rows/batch={number}"
        rows.write.mode("overwrite").parquet(at)
        new = spark.read.schema(schema).parquet(at).where(F.col(key).isNotNull()).select(key, F.lit(number).cast("long").alias("batch"))
        new.repartition(buckets, key).write.insertInto(name)

    rows = spark.readStream.schema(schema).json(landing)
    try:
        rows.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.sql(f"DROP TABLE {name}")  # its files stay


def ingested(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """The rows of all batches."""
    return spark.read.schema(schema).parquet(f"{table}/rows")


def tagged(spark: SparkSession, landing: str, schema: StructType | str, published: str, tag: Column, table: str, state: str) -> None:
    """Adds ``tag`` to the published rows of every batch that lands; a batch run again replaces its own rows."""

    def step(batch: DataFrame, number: int) -> None:
        batch.where(published).withColumn("tag", tag).write.mode("overwrite").parquet(f"{table}/batch={number}")

    rows = spark.readStream.schema(schema).json(landing)
    rows.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
