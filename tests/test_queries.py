"""Every query of the engine against its SQL, on DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from quern.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations pages".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        return float(f"{x:.9g}") if isinstance(x, float) and not math.isnan(x) else x

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = plain([tuple(r) for r in got.collect()], got.columns), plain(want.fetchall(), names)
    assert len(a) == len(b)
    assert a == b
