"""Exact row numbers and ids without a window over one large group.

Rows are range-partitioned by a total order, so partitions are balanced whatever the
group sizes; each row's number is its place in its partition plus the sizes of the
partitions before it. The partitioned rows are stored because the numbering reads them
more than once and range bounds are sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snarelight.operators.skew import lookup_join
from snarelight.session import stored

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def with_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the 0-based place of each row in ``order`` (which must be total)."""
    placed = (
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    ranged = stored(placed, "indexed").withColumn("_part", F.shiftright("_at", _ROW_BITS))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row per partition, so a single-task window and a broadcast are both bounded.
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    in_part = F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        ranged.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + in_part)
        .drop("_part", "_at", "_start")
    )


def with_group_positions(
    df: DataFrame, group: str, order: list[Column], position: str, total: str, small: bool | None = None
) -> DataFrame:
    """Adds the 1-based place of each row within its (non-NULL) group and the group's size.

    A partition holds a run of each of its groups. There are at most groups + partitions runs; their
    sizes, summed along a group, place the rows.
    """
    ordered = [F.col(group).asc(), *order]
    placed = df.repartitionByRange(*ordered).sortWithinPartitions(*ordered).withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(placed, "indexed").withColumn("_part", F.shiftright("_at", _ROW_BITS))
    runs = ranged.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        group,
        "_part",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) + 1 - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(W.partitionBy(group)).alias(total),
    )
    joined = lookup_join(ranged, runs, [group, "_part"], "inner", spread=["_at"], small=small)
    return joined.withColumn(position, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def with_new_ids(df: DataFrame, order: list[Column], name: str, last_used: int) -> DataFrame:
    """Dense ids after ``last_used``, the highest id ever given out (ids are not reused)."""
    return with_index(df, order, name).withColumn(name, F.col(name) + 1 + last_used)


def with_rank(df: DataFrame, score: str, name: str) -> DataFrame:
    """``RANK() OVER (ORDER BY score DESC)`` over all rows.

    Works on the distinct scores and their counts: running counts inside each range
    partition plus the totals of the partitions before it.
    """
    order = F.col(score).desc_nulls_last()
    counts = df.groupBy(score).agg(F.count(F.lit(1)).alias("_rows"))
    counts = stored(counts.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "scores")
    parts = counts.groupBy("_part").agg(F.sum("_rows").alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    ranks = (
        counts.withColumn("_above", F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
        .join(F.broadcast(starts), "_part")
        .select(score, (F.col("_start") + F.col("_above") + 1).alias(name))
    )
    return lookup_join(df, ranks, [score], "inner")
