"""All queries of the engine by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import base


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.plans import text_queries

    return text_queries.grapheme_lengths(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in base.load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in base.load().items() if q.sql}
