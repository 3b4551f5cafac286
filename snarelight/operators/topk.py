"""Top-k first, lookups afterwards.

A report of the k newest rows needs submitters, votes and rules of k rows only. The top
rows are stored, so the scan behind them runs once, and the other tables are cut down to
them by a broadcast of k keys instead of being shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snarelight.model import Tables
from snarelight.operators import rollups
from snarelight.operators.positions import with_index
from snarelight.operators.skew import BROADCAST_ROWS, lookup_join
from snarelight.session import stored


#: Up to so many rows are sorted and written by one task.
ONE_TASK_ROWS = 100_000


def top_rows(df: DataFrame, order: list[Column], limit: int, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """The first ``limit`` rows. ``order`` must be total: more rows are cut by their place in a range sort."""
    if limit <= one_task_rows:
        return stored(df.orderBy(*order).limit(limit), "top")
    return stored(with_index(df, order, "_place").where(F.col("_place") < limit).drop("_place"), "top")


def rows_of(df: DataFrame, top: DataFrame, key: str, limit: int | None, to: str | None = None) -> DataFrame:
    """The rows of ``df`` whose ``key`` occurs in ``top`` (in column ``to`` when named differently)."""
    keys = top.select(F.col(to or key).alias(key)).distinct()
    if limit is not None and limit <= BROADCAST_ROWS:
        return df.join(F.broadcast(keys), key, "left_semi")
    return lookup_join(df, keys, [key], "left_semi")


def with_people_and_votes(tables: Tables, urls: DataFrame, limit: int | None) -> DataFrame:
    """Adds submitter name and vote split; ``limit`` is the row bound of a top-k, None for whole tables."""
    people = tables.users.select("user_id", F.col("name").alias("submitter"))
    votes = tables.votes
    if limit is not None:
        people = rows_of(people, urls, "user_id", limit)
        votes = rows_of(votes, urls, "url_id", limit)
    named = lookup_join(urls, people, ["user_id"], "inner", ["url_id"])
    split = rollups.votes_by_url(votes).select("url_id", "phishing_votes", "legitimate_votes")
    return rollups.zero_if_null(named.join(split, "url_id", "left"), "phishing_votes", "legitimate_votes")
