"""Streams against batches, ingestion over several runs, numbering of lines and rows."""

from __future__ import annotations

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.operators import ordered
from quern.sources import jsonl
from quern.streaming import ingest, limiter

EVENTS = "event_id long, user_id long, ts timestamp"


def test_stream_of_limits_equals_the_batch(spark, tmp_path):
    draw = random.Random(7)
    begin = datetime(2024, 1, 1)
    rows = [(i, draw.randint(1, 3), begin + timedelta(seconds=draw.randint(0, 900))) for i in range(200)]
    early, later = [r for r in rows if r[2] < begin + timedelta(seconds=300)], [r for r in rows if r[2] >= begin + timedelta(seconds=300)]
    draw.shuffle(early), draw.shuffle(later)
    want = {tuple(r) for r in limiter.batch(spark.createDataFrame(rows, EVENTS), 60, 4).collect()}
    answered = 0
    for n, part in enumerate((early, later, [(-1, -1, begin + timedelta(days=2))])):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/landing/part={n}")
        d = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/landing/*")
        limiter.run(spark, limiter.stream(d, 60, 4, "5 minutes"), f"{tmp_path}/answers", f"{tmp_path}/state")
        got = {tuple(r) for r in spark.read.schema(limiter.ANSWER).parquet(f"{tmp_path}/answers").collect()}
        assert got <= want and len(got) >= answered  # what is answered is final
        answered = len(got)
    assert got == want and any(not r[5] and r[7] > 0 for r in got)


def test_stream_of_many_users_in_another_zone(spark, tmp_path):
    """Thirty thousand windows, a row of state each, by the session's clock; with a call of Python for each they took minutes."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        e = spark.range(40_000).select(F.col("id").alias("event_id"), (F.col("id") % 30_000).alias("user_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") % 977).alias("ts"))
        e.write.parquet(f"{tmp_path}/landing/part=0")
        e.limit(1).select(F.lit(-1).cast("long").alias("event_id"), "user_id", F.timestamp_seconds(F.lit(1_700_400_000)).alias("ts")).write.parquet(f"{tmp_path}/landing/part=1")
        answers = limiter.stream(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/landing/*"), 86_400, 1)
        assert "transformWithState" not in answers._jdf.queryExecution().analyzed().toString()
        limiter.run(spark, answers, f"{tmp_path}/answers", f"{tmp_path}/state")
        got = spark.read.schema(limiter.ANSWER).parquet(f"{tmp_path}/answers").where("event_id >= 0")
        want = limiter.batch(e, 86_400, 1)
        assert got.count() == 40_000 and got.exceptAll(want).count() == 0 and got.where("NOT allowed").count() > 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_late_duplicates_are_refused_and_no_state_is_kept(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, v string").schema
    runs = [[(1, "a"), (2, "a"), (2, "a"), (None, "x")], [(2, "b"), (3, "b")], [], [(1, "c"), (4, "c"), (None, "y")]]
    for n, rows in enumerate(runs):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/landing/batch={n}")
        ingest.run(spark, f"{tmp_path}/landing/*", schema, "id", f"{tmp_path}/table", f"{tmp_path}/state", buckets=4)
    got = sorted(((r.id or 0), r.v) for r in ingest.ingested(spark, f"{tmp_path}/table", schema).collect())
    assert got == [(0, "x"), (0, "y"), (1, "a"), (2, "a"), (3, "b"), (4, "c")]
    assert not os.path.exists(f"{tmp_path}/state/state")


def test_lines_are_numbered_over_pieces_of_files(spark, tmp_path):
    for name in "ab":
        with open(tmp_path / f"{name}.jsonl", "w") as f:
            f.write("".join(f"{json.dumps({'n': i, 'pad': 'x' * (i % 50)})}\n" + "\n" * (i % 3 == 0) for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = jsonl.strict(spark, str(tmp_path), "n long, pad string").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 1000
    for r in got:
        assert r.line == r.n + 1 + (r.n + 2) // 3


def test_bad_lines_are_named(spark, tmp_path):
    for n, bad in enumerate(("{x", "[1]", '{"n": "text"}', "1")):
        at = tmp_path / str(n)
        at.mkdir()
        (at / "a.jsonl").write_text(f'{{"n": 1}}\n\n{bad}\n')
        with pytest.raises(Exception, match="line 3 of"):
            jsonl.strict(spark, str(at), "n long").collect()
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "a.jsonl").write_text("\n \n")
    with pytest.raises(ValueError):
        jsonl.strict(spark, str(empty), "n long")


def test_rows_are_numbered_without_one_task_for_all(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v"))
    got = ordered.numbered(d, ["k"], "n")
    assert {r.k: r.n for r in got.collect()} == {k: k + 1 for k in range(1000)}
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert ordered.numbered(d.limit(0), ["k"], "n").count() == 0
