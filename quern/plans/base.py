"""Registration of queries: a decorator beside each query's definition, collected by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


_FOUND: dict[str, Query] = {}
_MODULES: tuple[str, ...] = tuple(
    f"quern.plans.{m}"
    for m in ("text_queries", "relational_queries", "lexicon_queries", "verb_queries", "entry_queries", "filter_queries", "summary_queries", "scan_queries", "analysis_queries", "search_queries", "promotion_queries", "request_queries", "annotation_queries")
)


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def keep(run: Run) -> Run:
        if name in _FOUND and _FOUND[name].run.__qualname__ != run.__qualname__:
            raise ValueError(f"two queries are named {name}")
        _FOUND[name] = Query(name, run, sql)
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> dict[str, Query]:
    for m in _MODULES:
        importlib.import_module(m)
    return dict(_FOUND)
