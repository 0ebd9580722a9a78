"""Fixed-window rate limits over requests: as a batch, and as a stream that answers every event once its window is over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: State on disk: a stream may have many open windows.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

ANSWER = "event_id long, user_id long, win long, used long, remaining long, allowed boolean, reset long, retry_after long"


def _second() -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))


def batch(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """For each event its window, how many the user made in it so far, how many remain, whether it is allowed, and when next.

    ``reset`` is the second in which the window ends, ``retry_after`` how many seconds that is from a refused event.
    Events of one second and user are ordered by event_id.
    """
    win = F.floor(_second() / seconds).cast("long")
    e = events.select("event_id", "user_id", "ts", _second().alias("second"), win.alias("win"))
    used = F.row_number().over(Window.partitionBy("user_id", "win").orderBy("ts", "event_id")).cast("long")
    e = e.withColumns({"used": used, "reset": (F.col("win") + 1) * seconds})
    e = e.withColumn("remaining", F.greatest(F.lit(0).cast("long"), limit - F.col("used"))).withColumn("allowed", F.col("used") <= limit)
    after = F.when(~F.col("allowed"), F.col("reset") - F.col("second"))
    return e.select("event_id", "user_id", "win", "used", "remaining", "allowed", "reset", after.alias("retry_after"))


def stream(events: DataFrame, seconds: int, limit: int, late: str = "10 minutes") -> DataFrame:
    """The rows of ``batch`` for a stream of events (event_id, user_id, ts), each once the watermark has passed its window.

    Events may come in any order within ``late``; state holds open windows alone, a row for each user and window with the
    events in it.  Windows are those of the session's clock, as in ``batch``.  ``run`` starts it.
    """
    e = events.select("event_id", "user_id", F.from_utc_timestamp("ts", F.current_timezone()).alias("ts")).withWatermark("ts", late)
    e = e.select("user_id", F.window("ts", f"{seconds} seconds").alias("window"), F.struct("ts", "event_id").alias("event"))
    d = e.groupBy("user_id", "window").agg(F.array_sort(F.collect_list("event")).alias("events"))
    reset = F.unix_seconds("window.end")
    d = d.select("user_id", reset.alias("reset"), F.posexplode("events").alias("place", "event"))
    used = (F.col("place") + 1).cast("long")
    after = F.when(used > limit, F.col("reset") - F.unix_seconds("event.ts"))
    return d.select(
        "event.event_id", "user_id", F.floor(F.col("reset") / seconds - 1).alias("win"), used.alias("used"),
        F.greatest(F.lit(0).cast("long"), limit - used).alias("remaining"), (used <= limit).alias("allowed"), "reset", after.alias("retry_after"),
    )


def run(spark: SparkSession, answers: DataFrame, table: str, state: str) -> None:
    """Answers all that has landed and stops."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        q = answers.writeStream.format("parquet").option("path", table).option("checkpointLocation", state)
        q.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)
