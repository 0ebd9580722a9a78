"""Joins over parts."""

from __future__ import annotations

from quern.plans import relational_queries

ROWS = [(1, "n", 1, "t", "b"), (2, "n", 1, "t", "b"), (3, "n", 1, "u", "b"), (4, "n", 1, "u", None), (4, "n", 1, "t", "x"), (5, None, 1, "t", "b"), (6, "n", 2, "t", "b"), (7, "n", 1, None, "b"), (4, "n", 1, "u", "b")]


def test_either_key_gives_each_pair_once_without_gathering_pairs(spark, tmp_path):
    part = spark.createDataFrame(ROWS, "p_partkey long, p_name string, p_size int, p_type string, p_brand string")
    part.write.parquet(f"{tmp_path}/part.parquet")
    d = relational_queries.jn12_or_equality(spark, str(tmp_path))
    meet = lambda a, b: None not in (a[1], b[1]) and a[1:3] == b[1:3] and any(a[i] == b[i] is not None for i in (3, 4))
    want = sorted({(a[0], b[0]) for a in ROWS for b in ROWS if a[0] < b[0] and meet(a, b)})
    assert sorted(map(tuple, d.collect())) == want
    # pairs of keys that one row has are not aggregated
    assert not d._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")
