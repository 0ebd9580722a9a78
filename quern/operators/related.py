"""Expressions that are linked to entries, a kind at a time: a kind that cannot be read fails by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def related(expressions: DataFrame, entries: DataFrame) -> DataFrame:
    """entry, kind, id, failed: the expressions (id, kind, linked: a JSON list of entries) of each entry (column entry).

    A kind with a row whose links are no list gives one row, with its name and ``failed``; the other kinds are whole.  An
    expression that names an entry twice is related to it once.
    """
    d = expressions.withColumn("links", F.from_json("linked", "array<string>"))
    kinds = d.groupBy("kind").agg(F.max(F.col("links").isNull()).alias("failed"))
    bad = kinds.where("failed").select(F.lit(None).cast("string").alias("entry"), "kind", F.lit(None).cast(d.schema["id"].dataType).alias("id"), "failed")
    good = d.join(F.broadcast(kinds.where("NOT failed").select("kind")), "kind", "left_semi")  # a row for each kind
    links = good.select("kind", "id", F.explode(F.array_distinct("links")).alias("entry"))
    found = links.join(entries.select("entry").distinct(), "entry", "left_semi")
    return found.select("entry", "kind", "id", F.lit(False).alias("failed")).unionByName(bad)
