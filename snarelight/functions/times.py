"""Time arithmetic on zone-less timestamps (the session time zone plays no part)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(as_of: datetime, **back) -> Column:
    """A fixed time, ``back`` (days=, minutes=) before ``as_of``."""
    return F.lit((as_of - timedelta(**back)).isoformat(sep=" ")).cast("timestamp_ntz")


def micros_between(start: Column, end: Column) -> Column:
    gap = end.cast("timestamp_ntz") - start.cast("timestamp_ntz")
    return (gap.cast("interval second").cast("decimal(24,6)") * 1_000_000).cast("bigint")


def micros(at: Column) -> Column:
    return micros_between(F.lit("1970-01-01").cast("timestamp_ntz"), at)
