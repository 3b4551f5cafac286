"""Threat-feed import."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snarelight.functions.text import blank_to_null, strip, strip_or
from snarelight.functions.times import moment
from snarelight.functions.urls import malformed_host, with_url_parts
from snarelight.model import PHISHING, Tables
from snarelight.operators.positions import with_new_ids
from snarelight.operators.topk import top_rows
from snarelight.plans.maintenance import Change, shaped

FEED_EMAIL = "threat-feed@snarelight.example"
# Feed names, label prefix and the batch size.
FEED_NAME = "URLHaus Feed"
LABEL_PREFIX = "URLHaus: "
FEED_ROLE = "analyst"
FEED_LIMIT = 250


def ensure_feed_user(
    tables: Tables, as_of: datetime, email: str = FEED_EMAIL, name: str = FEED_NAME
) -> Tables:
    """Adds the feed's account unless the email is taken."""
    highest = F.coalesce(tables.users.agg(F.max("user_id")).scalar(), F.lit(0))
    missing = tables.users.where(F.col("email") == email).agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
    account = missing.select(
        (F.greatest(highest, F.lit(tables.last_ids.get("users", 0))) + 1).alias("user_id"),
        F.lit(name).alias("name"),
        F.lit(email).alias("email"),
        F.lit(FEED_ROLE).alias("role"),
        moment(as_of).alias("created_at"),
    )
    return tables.with_tables(users=shaped(tables.users, "users").unionByName(shaped(account, "users")))


def _or_now(text: Column, as_of: datetime) -> Column:
    return F.coalesce(text.try_cast("timestamp_ntz"), moment(as_of))


def _with_urls(feed: DataFrame) -> DataFrame:
    return feed.withColumn("url", strip(F.coalesce("url", F.lit("")))).where(F.col("url") != "")


def feed_rejects(feed: DataFrame) -> DataFrame:
    """Feed rows whose URL has no valid host: seq, url and reason."""
    bad = _with_urls(feed).where(malformed_host(F.col("url")))
    return bad.select("seq", "url", F.lit("malformed_host").alias("reason"))


def feed_details(feed: DataFrame, as_of: datetime) -> DataFrame:
    """Feed rows (seq and the CSV columns as text) with URL parts and review text; blank and malformed URLs dropped.

    Plain projections, so streams use them too.
    """
    added, seen = blank_to_null(F.col("dateadded")), blank_to_null(F.col("last_online"))
    status = F.coalesce(blank_to_null(strip_or(F.col("url_status"), "unknown")), F.lit("unknown"))
    tags = F.coalesce(blank_to_null(strip_or(F.col("tags"), "n/a")), F.lit("n/a"))
    rows = _with_urls(feed).where(~malformed_host(F.col("url")))
    return with_url_parts(rows).select(
        "seq",
        "url",
        "url_domain",
        "tld",
        F.lit(PHISHING).alias("result_code"),
        _or_now(added, as_of).alias("created_at"),
        F.concat(F.lit(LABEL_PREFIX), strip_or(F.col("threat"), "Threat")).alias("label"),
        F.concat(
            F.lit("Status: "), status, F.lit("; Tags: "), tags, F.lit("; Last seen: "), F.coalesce(seen, F.lit("n/a")), F.lit(".")
        ).alias("description"),
        _or_now(F.coalesce(seen, added), as_of).alias("reviewed_at"),
    )


def first_per_url(rows: DataFrame) -> DataFrame:
    """The row with the lowest seq of each URL; repeats are combined before the shuffle."""
    return (
        rows.groupBy("url")
        .agg(F.min_by(F.struct(*[c for c in rows.columns if c != "url"]), "seq").alias("_first"))
        .select("url", "_first.*")
    )


@dataclass(frozen=True)
class FeedImport:
    """``inserted`` holds the new rows; ``summary`` one row with inserted and skipped; ``rejected`` the malformed URLs."""

    inserted: DataFrame
    summary: DataFrame
    rejected: DataFrame


def feed_import(tables: Tables, feed: DataFrame, as_of: datetime, limit: int = FEED_LIMIT) -> FeedImport:
    """The first ``limit`` feed URLs (0: all) that are not stored yet, in feed order.

    Rows up to the last insert that bring no new URL count as skipped.
    """
    rows = feed_details(feed, as_of)
    fresh = first_per_url(rows).join(tables.url_submissions.select("url"), "url", "left_anti")
    read = rows.select("seq")
    if limit:
        fresh = top_rows(fresh, [F.col("seq").asc()], limit)
        # The import stops before the row after the last insert, if it got that far.
        end = fresh.agg(F.when(F.count(F.lit(1)) >= limit, F.max("seq")).alias("end")).scalar()
        read = read.where(end.isNull() | (F.col("seq") <= end))
    inserted = fresh.agg(F.count(F.lit(1))).scalar()
    summary = read.agg(F.count(F.lit(1)).alias("read")).select(
        inserted.alias("inserted"), (F.col("read") - inserted).alias("skipped")
    )
    return FeedImport(fresh, summary, feed_rejects(feed))


def store_feed(
    tables: Tables,
    inserted: DataFrame,
    as_of: datetime,
    email: str = FEED_EMAIL,
    last_url_id: int | None = None,
    last_status_id: int | None = None,
) -> Change:
    """Adds the imported URLs under the feed user, each with its first review."""
    ready = ensure_feed_user(tables, as_of, email)
    owner = ready.users.where(F.col("email") == email).agg(F.min("user_id")).scalar()
    if last_url_id is None:
        last_url_id = tables.last_id("url_submissions")
    if last_status_id is None:
        last_status_id = tables.last_id("statuses")
    numbered = with_new_ids(inserted, [F.col("seq").asc()], "url_id", last_url_id)
    urls = numbered.withColumn("user_id", owner).withColumn("updated_at", F.lit(None))
    reviews = (
        numbered.withColumn("status_id", F.col("url_id") - last_url_id + last_status_id)
        .withColumn("reviewer_id", F.lit(None))
        .withColumn("created_at", F.col("reviewed_at"))
    )
    return Change(
        ready.with_tables(
            url_submissions=tables.url_submissions.unionByName(shaped(urls, "url_submissions")),
            statuses=tables.statuses.unionByName(shaped(reviews, "statuses")),
        ),
        numbered.select("url_id"),
    )
