"""Connected components of links between documents, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import common


def components(links: DataFrame) -> DataFrame:
    """For each end of the links (columns a, b) its id and component: the smallest id reachable from it.

    Every round takes the least label among neighbours and follows labels one step further (pointer jumping), so chains
    halve; a round's labels are written to the shared folder, which also ends their lineage.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = common.written(both, "links")
    labels = both.groupBy("a").agg(F.min("b").alias("near"))
    labels = common.written(labels.select(F.col("a").alias("id"), F.least("a", "near").alias("label")), "labels")
    while True:
        jumped = labels.join(labels.select(F.col("id").alias("label"), F.col("label").alias("next")), "label")
        near = (
            both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("at")), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("at").alias("at"))
        )
        new = jumped.join(near, "id").select("id", "label", F.least("next", "at").alias("new"))
        new = common.written(new, "labels")
        labels = new.select("id", F.col("new").alias("label"))
        if new.where("new <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
