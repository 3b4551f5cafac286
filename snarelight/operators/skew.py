"""Joins that stay balanced when one key holds a large share of the rows.

``many`` may repeat a key any number of times, ``one`` holds each key once. When ``one``
is small (checked, not assumed) it is broadcast and ``many`` is never shuffled. Otherwise
keys with more than ``hot_rows`` rows are spread over several salts and only the matching
rows of ``one`` are copied, so no task receives more than about ``hot_rows`` rows of a key.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
BROADCAST_ROWS = 20_000
NULL_SALTS = 4096


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; ``take`` stops reading once it has more."""
    return len(df.select(F.lit(1)).take(max_rows + 1)) <= max_rows


def parts_for(*tables: DataFrame, task_rows: int) -> int:
    """In how many parts the rows of ``tables`` are dealt so that a task gets about ``task_rows``; 1 if no more than that."""
    rows = sum(df.count() for df in tables)
    return 1 if rows <= task_rows else max(-(-rows // task_rows), tables[0].sparkSession.sparkContext.defaultParallelism)


def dealt(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """``df`` dealt to so many tasks by ``keys``.

    Without a number, adaptive execution joins partitions up to a size in compressed bytes, and files are split by
    theirs: millions of narrow rows for a task that sorts or groups them.
    """
    return df.repartition(parts, *keys) if parts > 1 else df


def _hot_keys(many: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """Keys above ``hot_rows`` and their salt counts: at most rows/hot_rows entries."""
    return (
        many.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > hot_rows)
        .select(*keys, F.ceil(F.col("_rows") / hot_rows).alias("_salts"))
    )


def lookup_join(
    many: DataFrame,
    one: DataFrame,
    keys: list[str],
    how: str = "inner",
    spread: list[str] | None = None,
    small: bool | None = None,
    sizes_from: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``many`` joined to ``one``; ``how`` is inner, left, left_semi or left_anti.

    ``spread`` names columns of ``many`` that tell apart the rows of a key (its id).
    ``small=False`` skips the size check, for a ``one`` that is costly to compute.
    ``sizes_from`` is a cheaper table to count the keys in, when ``many`` is itself the
    result of joins or aggregations: it must hold at least as many rows of each hot key.
    """
    if small is None:
        small = is_small(one)
    if small:
        return many.join(F.broadcast(one), keys, how)
    hot = F.broadcast(_hot_keys(many if sizes_from is None else sizes_from, keys, hot_rows))
    salted_many = _spread(many, hot, keys, spread).drop("_salts")
    salted_one = _copied(one, hot, keys).drop("_salts")
    return salted_many.join(salted_one, [*keys, "_salt"], how).drop("_salt")


def expand_join(
    one: DataFrame,
    many: DataFrame,
    keys: list[str],
    spread: list[str] | None = None,
    small: bool | None = None,
    sizes_from: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left outer join from the unique side: every row of ``one`` with all its ``many`` rows.

    ``sizes_from``, where given, must have the same keys as ``many``.
    """
    hot = F.broadcast(_hot_keys(many if sizes_from is None else sizes_from, keys, hot_rows))
    if is_small(one) if small is None else small:
        many = many.join(F.broadcast(one.select(*keys)), keys, "left_semi")
    salted_many = _spread(many, hot, keys, spread).drop("_salts").withColumn("_match", F.lit(True))
    joined = _copied(one, hot, keys).join(salted_many, [*keys, "_salt"], "left")
    # A hot key has rows, so a copy of its ``one`` row that met none is not a result.
    return joined.where(F.col("_match").isNotNull() | F.col("_salts").isNull()).drop("_match", "_salt", "_salts")


def _spread(many: DataFrame, hot: DataFrame, keys: list[str], spread: list[str] | None) -> DataFrame:
    """Rows of hot keys, and rows without a key, get one of several salts; the others salt 0."""
    no_key: Column = reduce(or_, [F.col(k).isNull() for k in keys])
    salt = F.xxhash64(*(spread or many.columns))
    return many.join(hot, keys, "left").withColumn(
        "_salt",
        F.when(no_key, F.pmod(salt, F.lit(NULL_SALTS)))
        .when(F.col("_salts").isNotNull(), F.pmod(salt, F.col("_salts")))
        .otherwise(F.lit(0).cast("bigint")),
    )


def _copied(one: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of hot keys once per salt, the others once."""
    last_salt = F.coalesce(F.col("_salts"), F.lit(1)) - 1
    salts = F.sequence(F.lit(0).cast("bigint"), last_salt)
    return one.join(hot, keys, "left").withColumn("_salt", F.explode(salts))
