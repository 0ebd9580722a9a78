"""Queries that SQL can express, against their SQL."""

from __future__ import annotations

import duckdb
import pytest

from quern.llm import queries
from tests.test_queries import plain

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = plain([tuple(r) for r in got.collect()], got.columns), plain(want.fetchall(), names)
    assert a == b and a
