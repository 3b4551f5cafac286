"""Streaming forms of intake, voting, feed import and sessions.

Batches are written to a folder per batch number, overwritten on replay, so a restarted
stream neither loses nor repeats rows. ``snarelight.sources.snapshots`` takes the results
over into the tables. A batch reads what it needs of the batches before it from level
stores: its cost follows its own rows, not the age of the stream.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from snarelight.functions.times import moment
from snarelight.model import Tables
from snarelight.operators import voting
from snarelight.operators.sessions import GAP_HOURS
from snarelight.plans.feed import feed_details, first_per_url
from snarelight.plans.intake import checked_urls, submit_urls
from snarelight.plans.rules_engine import rule_hits
from snarelight.session import shared_path, stored, temporary_folders
from snarelight.streaming.known import BUCKETS, KnownUrls
from snarelight.streaming.levels import FAN, SEGMENT, LevelStore


def _write(df: DataFrame, out: str, kind: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{out}/{kind}/batch={batch}")


def _start(stream: DataFrame, handle, out: str, trigger: dict | None = None) -> StreamingQuery:
    """``trigger`` as for ``DataStreamWriter.trigger``; by default what is available now, then the stream ends."""

    def handle_stored(batch: DataFrame, number: int) -> None:
        with temporary_folders(batch.sparkSession):
            handle(stored(batch, "batch"), number)

    return (
        stream.writeStream.foreachBatch(handle_stored)
        .option("checkpointLocation", f"{out}/progress")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_submit(
    stream: DataFrame, tables: Tables, out: str, trigger: dict | None = None, buckets: int = BUCKETS, fan: int = FAN
) -> StreamingQuery:
    """Validates arriving submissions (seq, user_id, url, result_code) and matches the rules.

    Writes ``accepted``, ``rejected`` and ``hits`` (rule hits by seq). A URL is new when
    neither the tables nor an earlier batch hold it: see ``KnownUrls`` for what a batch reads.
    """
    KnownUrls(tables.spark, f"{out}/known", buckets).start(tables.url_submissions)

    def handle(batch: DataFrame, number: int) -> None:
        known = KnownUrls(batch.sparkSession, f"{out}/known", buckets, fan)
        known.added.compact(number)
        held = known.among(checked_urls(batch).where("reason is null"), number)
        intake = submit_urls(tables.with_tables(url_submissions=held), batch)
        _write(intake.accepted, out, "accepted", number)
        _write(intake.rejected, out, "rejected", number)
        accepted = batch.sparkSession.read.parquet(f"{out}/accepted/batch={number}")
        hits = rule_hits(accepted.withColumn("url_id", F.col("seq")), tables.rules)
        _write(hits.withColumnRenamed("url_id", "seq"), out, "hits", number)
        known.add(accepted, number)

    return _start(stream, handle, out, trigger)


def stream_feed(
    stream: DataFrame, tables: Tables, out: str, as_of: datetime, trigger: dict | None = None, buckets: int = BUCKETS, fan: int = FAN
) -> StreamingQuery:
    """Imports arriving feed rows (seq and the CSV columns) without a batch limit."""
    KnownUrls(tables.spark, f"{out}/known", buckets).start(tables.url_submissions)

    def handle(batch: DataFrame, number: int) -> None:
        known = KnownUrls(batch.sparkSession, f"{out}/known", buckets, fan)
        known.added.compact(number)
        rows = stored(first_per_url(feed_details(batch, as_of)), "feed-rows")
        _write(rows.join(known.among(rows, number), "url", "left_anti"), out, "accepted", number)
        known.add(batch.sparkSession.read.parquet(f"{out}/accepted/batch={number}"), number)

    return _start(stream, handle, out, trigger)


#: How late a vote may come behind the newest one of the batches before.
VOTE_DELAY = timedelta(hours=1)
_VOTE = "event_id bigint, ts timestamp_ntz, user_id bigint, url_id bigint, vote_value int"
_SUMMARY = "user_id bigint, url_id bigint, vote_value int, run bigint, whole boolean, ts timestamp_ntz, event_id bigint"


def _summaries(spark: SparkSession, out: str, fan: int = FAN) -> LevelStore:
    return LevelStore(spark, f"{out}/summaries", _SUMMARY, voting.combine_segments, fan)


def _last_before(spark: SparkSession, out: str, kind: str, schema: str, batch: int | None) -> DataFrame:
    """What the newest batch before ``batch`` wrote of ``kind``; every batch writes it."""
    try:
        rows = spark.read.schema(f"{schema}, batch bigint").parquet(f"{out}/{kind}")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise
    numbers = spark.read.schema("batch bigint").parquet(f"{out}/{kind}").select("batch").distinct()
    newest = (numbers if batch is None else numbers.where(F.col("batch") < batch)).agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == (-1 if newest is None else newest)).drop("batch")


def stream_votes(
    stream: DataFrame, out: str, trigger: dict | None = None, delay: timedelta = VOTE_DELAY, fan: int = FAN
) -> StreamingQuery:
    """Folds arriving vote events (event_id, ts, user_id, url_id, vote_value) in order of time.

    The watermark of a batch is the newest time of the batches before it less ``delay``. Events before the
    watermark go to ``late`` with it, events with an invalid value to ``rejected``. Events that the next
    watermark passes are summarised as the batch's segment, so segments are ranges of time and one
    event is folded in one place of the log whenever it arrives; the others wait in ``waiting``, which
    holds the events of the last ``delay`` only. Segments are merged by levels.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        summaries = _summaries(spark, out, fan)
        summaries.compact(number)
        newest = _last_before(spark, out, "newest", "ts timestamp_ntz", number).first()
        before = newest.ts if newest else None
        columns = [F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "url_id", F.col("vote_value").cast("int").alias("vote_value")]
        valid = voting.valid_votes(batch).select("event_id", *columns)
        _write(voting.invalid_votes(batch), out, "rejected", number)
        mark = F.lit(False) if before is None else F.col("ts") < moment(before - delay)
        watermark = F.lit(None).cast("timestamp_ntz") if before is None else moment(before - delay)
        _write(valid.where(mark).withColumn("watermark", watermark), out, "late", number)
        now = max((t for t in (before, valid.agg(F.max("ts")).first()[0]) if t is not None), default=None)
        waiting = _last_before(spark, out, "waiting", _VOTE, number).unionByName(valid.where(~mark))
        due = F.lit(False) if now is None else F.col("ts") < moment(now - delay)
        summaries.write(voting.summarise_log(waiting.where(due)), number)
        _write(waiting.where(~due), out, "waiting", number)
        # Last, as the next batch starts from it.
        _write(spark.createDataFrame([(now,)], "ts timestamp_ntz"), out, "newest", number)
        for kind in ("waiting", "newest"):  # a batch that runs again reads those of the one before
            path, files = shared_path(spark, f"{out}/{kind}/batch={number - 2}")
            files.delete(path, True)

    return _start(stream, handle, out, trigger)


def current_votes(spark: SparkSession, out: str, stored_votes: DataFrame | None = None) -> DataFrame:
    """The votes after all batches, on top of the ``stored_votes`` they continue from.

    Reads the segments left by compaction, a few for each size, and the events still waiting, as the last segment.
    """
    waiting = voting.summarise_log(_last_before(spark, out, "waiting", _VOTE, None))
    summaries = _summaries(spark, out).read().unionByName(waiting.withColumn(SEGMENT, F.lit((1 << 62)).cast("bigint")))
    if stored_votes is not None:
        before = voting.as_summaries(stored_votes).withColumn(SEGMENT, F.lit(-1).cast("bigint"))
        summaries = summaries.unionByName(before)
    return voting.standing_votes(voting.combine_segments(summaries))


def stream_sessions(
    stream: DataFrame, out: str, delay: str = "1 hour", gap_hours: int = GAP_HOURS, trigger: dict | None = None
) -> StreamingQuery:
    """Closed sessions of arriving events (user_id, ts); ``delay`` bounds how late events may come."""
    sessions = (
        stream.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy(F.session_window("ts", f"{gap_hours} hours").alias("session"), "user_id")
        .agg(F.count(F.lit(1)).alias("event_count"), F.max("ts").alias("last_seen"))
        .select(
            "user_id",
            F.col("session.start").cast("timestamp_ntz").alias("session_start"),
            F.col("last_seen").cast("timestamp_ntz").alias("last_seen"),
            F.col("session.end").cast("timestamp_ntz").alias("expires_at"),
            "event_count",
        )
    )
    return (
        sessions.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{out}/sessions")
        .option("checkpointLocation", f"{out}/progress")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def open_sessions(spark: SparkSession, out: str) -> DataFrame:
    """Sessions that were open when the stream last stopped, from its state store, in the columns of the closed ones."""
    state = spark.read.format("statestore").load(f"{out}/progress")
    value = state.select("value.*")
    # What the aggregates keep: the window, the user, and the buffers of count and max by name.
    return value.select(
        "user_id",
        F.col("session_window.start").cast("timestamp_ntz").alias("session_start"),
        F.col("max").cast("timestamp_ntz").alias("last_seen"),
        F.col("session_window.end").cast("timestamp_ntz").alias("expires_at"),
        F.col("count").alias("event_count"),
    )
