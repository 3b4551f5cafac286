"""Attaching the rule catalogue to rows of another table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_catalogue(df: DataFrame, catalogue: DataFrame, name: str) -> DataFrame:
    """Adds the catalogue rows as one array, sorted by the catalogue's first columns.

    The array is read once, as a scalar subquery, and shared by all rows: no join, and the
    same shape whatever the catalogue's size. A result row that lists rules has to hold
    nearly all of them anyway.
    """
    entry = F.struct(*[F.col(c) for c in catalogue.columns])
    return df.withColumn(name, catalogue.agg(F.array_sort(F.collect_list(entry))).scalar())
