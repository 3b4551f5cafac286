"""Folding a vote log into current votes.

Casting the same value again takes a vote back; the other value replaces it. So a vote
stands exactly when the last value was cast an odd number of times in a row. The log is
cut into segments; each is summarised by its last value, the length of the final run and
whether the run fills the segment, and summaries are combined in segment order. One
(user, url) pair with very many events thus never meets in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snarelight.model import VOTE_VALUES

PAIR = ["user_id", "url_id"]


def valid_votes(log: DataFrame) -> DataFrame:
    return log.where(F.col("vote_value").isin(*VOTE_VALUES))


def invalid_votes(log: DataFrame) -> DataFrame:
    return log.where(~F.coalesce(F.col("vote_value").isin(*VOTE_VALUES), F.lit(False)))


def summarise_segments(log: DataFrame) -> DataFrame:
    """One row per (user, url, segment) of a log (user_id, url_id, segment, ts, event_id, vote_value)."""
    newest_first = W.partitionBy(*PAIR, "segment").orderBy(F.desc("ts"), F.desc("event_id"))
    placed = log.withColumn("_place", F.row_number().over(newest_first)).withColumn(
        "_last", F.first("vote_value").over(newest_first)
    )
    newest = F.col("_place") == 1
    broken_at = F.min(F.when(F.col("vote_value") != F.col("_last"), F.col("_place")))
    return placed.groupBy(*PAIR, "segment").agg(
        F.first("_last").alias("vote_value"),
        F.coalesce(broken_at - 1, F.count(F.lit(1))).cast("bigint").alias("run"),
        broken_at.isNull().alias("whole"),
        F.max(F.when(newest, F.col("ts"))).alias("ts"),
        F.max(F.when(newest, F.col("event_id"))).alias("event_id"),
    )


def combine_segments(summaries: DataFrame) -> DataFrame:
    """One summary per (user, url) from the summaries of its segments, taken in segment order."""
    newest_first = W.partitionBy(*PAIR).orderBy(F.desc("segment"))
    placed = summaries.withColumn("_place", F.row_number().over(newest_first)).withColumn(
        "_last", F.first("vote_value").over(newest_first)
    )
    same = F.col("vote_value") == F.col("_last")
    ends_run = ~(same & F.col("whole"))
    # The first segment that ends the run still adds its own final run if the value agrees.
    placed = placed.withColumn("_ended", F.count_if(ends_run).over(newest_first)).withColumn(
        "_adds",
        F.when(F.col("_ended") == 0, F.col("run"))
        .when((F.col("_ended") == 1) & ends_run & same, F.col("run"))
        .otherwise(0),
    )
    newest = F.col("_place") == 1
    return placed.groupBy(*PAIR).agg(
        F.first("_last").alias("vote_value"),
        F.sum("_adds").alias("run"),
        (F.max("_ended") == 0).alias("whole"),
        F.max(F.when(newest, F.col("ts"))).alias("ts"),
        F.max(F.when(newest, F.col("event_id"))).alias("event_id"),
    )


def summarise_log(log: DataFrame) -> DataFrame:
    """One summary per (user, url) of a log; segments are ranges of the total event order."""
    ranged = (
        valid_votes(log)
        .select(*PAIR, "ts", "event_id", "vote_value")
        .repartitionByRange(*PAIR, "ts", "event_id")
        .withColumn("segment", F.spark_partition_id())
    )
    return combine_segments(summarise_segments(ranged))


def standing_votes(summaries: DataFrame) -> DataFrame:
    """The votes that are not taken back, with the time of their last cast."""
    return summaries.where(F.col("run") % 2 == 1).select(
        F.col("event_id").alias("vote_id"), *PAIR, "vote_value", F.col("ts").alias("created_at")
    )


def fold_votes(log: DataFrame) -> DataFrame:
    return standing_votes(summarise_log(log))


def as_summaries(votes: DataFrame) -> DataFrame:
    """Stored votes as summaries to continue from: one cast, with nothing before it that matters."""
    return votes.select(
        *PAIR,
        "vote_value",
        F.lit(1).cast("bigint").alias("run"),
        F.lit(False).alias("whole"),
        F.col("created_at").alias("ts"),
        F.col("vote_id").alias("event_id"),
    )
