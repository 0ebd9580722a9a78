"""Operators over ordered rows: carried state, numbering, gaps, budgets, rotation, first matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.sources import jsonl


def carried(df: DataFrame, value: Column, by: list[str], order: list[Column], out: str, default: Column) -> DataFrame:
    """Adds the latest non-null ``value`` up to each row of its group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(w), default))


def firsts(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group; with n = 1 a first-match or a first-seen dedupe."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def gaps(df: DataFrame, key: str) -> DataFrame:
    """Runs of whole numbers between the least and greatest ``key`` that no row has: first, last, missing.

    Neighbours are compared within ranges of keys, and only the ends of the ranges meet in one small window, so no task
    sees all keys.
    """
    width = 1 << 20
    k = df.select(F.col(key).cast("long").alias("k")).where("k IS NOT NULL").distinct()
    k = k.withColumn("part", F.floor(F.col("k") / width))
    inner = k.withColumn("after", F.lead("k").over(Window.partitionBy("part").orderBy("k"))).where("after > k + 1")
    ends = k.groupBy("part").agg(F.min("k").alias("low"), F.max("k").alias("high"))  # one row for 2**20 keys
    between = ends.withColumn("after", F.lead("low").over(Window.orderBy("part"))).where("after > high + 1")
    found = inner.select("k", "after").union(between.select("high", "after"))
    return found.select(
        (F.col("k") + 1).alias("first_missing"),
        (F.col("after") - 1).alias("last_missing"),
        (F.col("after") - F.col("k") - 1).alias("missing"),
    )


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds the number of each row (from 1) in ascending order of columns that tell all rows apart.

    Rows are dealt by ranges of the order and numbered within them; the driver sees how many each range has.
    """
    parts = jsonl.kept(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    return _offset(parts, ["__part"], [F.col(c) for c in order], out).drop("__part")


def _offset(parts: DataFrame, within: list[str], order: list[Column], out: str) -> DataFrame:
    """Numbers rows over parts that follow each other: the place in the part and the rows of the parts before."""
    *outer, last = within
    counts = sorted(tuple(r) for r in parts.groupBy(*within).count().collect())
    rows, before = [], {}
    for *names, n in counts:
        group = tuple(names[:-1])
        rows.append((*names, before.get(group, 0)))
        before[group] = before.get(group, 0) + n
    schema = ", ".join(f"`{c}` {parts.schema[c].dataType.simpleString()}" for c in within)
    offsets = parts.sparkSession.createDataFrame(rows, f"{schema}, __before long")
    d = parts.withColumn("__n", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
    return d.join(F.broadcast(offsets), within).withColumn(out, F.col("__before") + F.col("__n")).drop("__before", "__n")  # a row for each part


def numbered_files(lines: DataFrame, out: str) -> DataFrame:
    """Adds the number (from 1) of each line in its file to lines with file, block (where its piece of the file begins) and id.

    ``id`` ascends within a piece; pieces are numbered each by itself, however long the file.
    """
    return _offset(jsonl.kept(lines, "lines"), ["file", "block"], [F.col("id")], out).drop("block", "id")


def rotated(df: DataFrame, key: str, seed: int, limit: int, ranges: int = 1000) -> DataFrame:
    """The first ``limit`` rows in order of ``key``, begun ``seed`` places on (round the end; negative seeds, too).

    ``key`` is a number without ties.  Rows are counted by ranges of it (the driver sees so many counts), which shows in
    which range the start lies; only from there on are rows put in order, so no task holds more than a range and a page.
    """
    cuts = df.agg(F.min(key).alias("least"), F.percentile_approx(key, [i / ranges for i in range(ranges)], 20 * ranges).alias("cuts")).first()
    if cuts["least"] is None:
        return df.withColumn("place", F.lit(0).cast("long")).limit(0)
    starts = sorted({cuts["least"], *cuts["cuts"]})
    number = F.size(F.filter(F.array(*map(F.lit, starts)), lambda x: x <= F.col(key)))
    counts = {r["r"]: r["count"] for r in df.groupBy(number.alias("r")).count().collect()}
    n = sum(counts.values())
    rest, at = seed % n, 1
    while rest >= counts.get(at, 0):
        rest -= counts.get(at, 0)
        at += 1
    rows = df.where(F.col(key) >= starts[at - 1]).orderBy(key).offset(rest).limit(limit).withColumn("__lap", F.lit(0))
    more = max(0, min(limit, n) - (n - seed % n))
    if more:
        rows = rows.union(df.orderBy(key).limit(more).withColumn("__lap", F.lit(1)))
    place = F.row_number().over(Window.orderBy("__lap", key))  # at most `limit` rows
    return rows.withColumn("place", (place - 1).cast("long")).drop("__lap")


def budgeted(tiers: list[DataFrame], order: list[str], limit: int) -> DataFrame:
    """Rows of the first tier, then of the next, until ``limit`` rows are there; ``tier`` numbers them from 0."""
    out = None
    for n, t in enumerate(tiers):
        part = t.orderBy(*order).limit(limit).withColumn("tier", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("tier", *order).limit(limit)
