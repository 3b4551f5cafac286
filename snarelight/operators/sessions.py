"""Activity sessions with a sliding expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snarelight.functions.times import micros, micros_between

GAP_HOURS = 8


def user_sessions(events: DataFrame, gap_hours: int = GAP_HOURS) -> DataFrame:
    """Sessions per user from (user_id, ts): a longer gap than ``gap_hours`` starts a new one.

    Events are first combined per user and clock slot of the gap's length: two events in a
    slot are always less than the gap apart. What reaches the per-user window is at most
    one row per slot, however many events a user has.
    """
    gap_micros = gap_hours * 3_600_000_000
    slots = (
        events.withColumn("_slot", F.floor(micros(F.col("ts")) / gap_micros))
        .groupBy("user_id", "_slot")
        .agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.count(F.lit(1)).alias("_events"))
    )
    by_time = W.partitionBy("user_id").orderBy("_slot")
    silence = micros_between(F.lag("_last").over(by_time), F.col("_first"))
    numbered = slots.withColumn("_starts", F.coalesce(silence > gap_micros, F.lit(True)).cast("int")).withColumn(
        "_session", F.sum("_starts").over(by_time)
    )
    return (
        numbered.groupBy("user_id", "_session")
        .agg(
            F.min("_first").alias("session_start"),
            F.max("_last").alias("last_seen"),
            F.sum("_events").alias("event_count"),
        )
        .select(
            "user_id",
            "session_start",
            "last_seen",
            (F.col("last_seen") + F.expr(f"INTERVAL {gap_hours} HOURS")).alias("expires_at"),
            "event_count",
        )
    )
