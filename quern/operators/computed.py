"""Filters on computed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows that meet a condition on long chains of computed columns.

    A plain filter would be moved below the chain, with a copy of it for each time a column is named; beside a column
    that is not deterministic it stays where it is.
    """
    c = F.expr(condition) if isinstance(condition, str) else condition
    d = df.withColumn("__at", F.monotonically_increasing_id())
    return d.where(c & (F.col("__at") >= 0)).drop("__at")
