"""Sharding by Karmarkar-Karp differencing: byte balance for groups that can't be split.

Rows with equal texts are one group and go to one shard. Differencing repeatedly takes the two
partial partitions with the largest spread and adds them oppositely ordered, largest shard to
smallest. To run at scale it works on levels: random buckets of about ``BUCKET_ITEMS`` groups are
each differenced into bins, the bins are the items of the next level, and when about ``TOP_ITEMS``
are left one last differencing deals them to the shards. Every task holds one bucket at most.

Null texts are one group of size 8 per row (texts' bytes plus 8). Empty texts are another. Repeated
rows are rows of their own in their group's shard. Empty tables give empty results. Input columns
with the name of a result are replaced.
"""

from __future__ import annotations

import heapq
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snarelight.llm.common import hot_join, lookup_join, packed, stored, unpacked, with_running_totals, without

BUCKET_ITEMS = 20_000
TOP_ITEMS = 12_288
ROW_BYTES = 8
RESULTS = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def differenced(sizes: list[int], ways: int) -> list[int]:
    """The way (0..ways-1) of each item, by largest differencing.

    A partial partition is the list of its filled ways, largest first, as (sum, members), where
    members is an item or a pair of members; ways that are not listed are empty.
    """
    if not sizes:
        return []
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - ways
        if over <= 0:
            merged = a + b
        else:
            # The smallest filled ways of a meet the smallest of b, so that large meets small.
            pairs = zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True)
            merged = a[: len(a) - over] + b[: len(b) - over] + [(x[0] + y[0], (x[1], y[1])) for x, y in pairs]
        merged.sort(key=itemgetter(0), reverse=True)
        least = merged[-1][0] if len(merged) == ways else 0
        heapq.heappush(heap, (least - merged[0][0], made, merged))
        made += 1
    out = [0] * len(sizes)
    for way, (_, members) in enumerate(heap[0][2]):
        todo = [members]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x)
            else:
                out[x] = way
    return out


def _dealt(items: DataFrame, bucket: str, ways: int) -> DataFrame:
    """``items`` (_id, _bytes, and ``bucket``) with the way that each gets within its bucket."""

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_bytes", "_id"], ascending=[False, True], ignore_index=True)
        return rows.assign(_way=differenced(rows["_bytes"].tolist(), ways))[["_id", "_bytes", "_bucket", "_way"]]

    named = items.select("_id", "_bytes", F.col(bucket).alias("_bucket"))
    return named.groupBy("_bucket").applyInPandas(deal, "_id string, _bytes long, _bucket long, _way int")


def group_shards(groups: DataFrame, shards: int) -> DataFrame:
    """The shard of each group; ``groups`` has unique ``_id`` (string) and ``_bytes`` (long)."""
    levels = []
    items = stored(groups.select("_id", "_bytes"), "groups")
    while (n := items.count()) > TOP_ITEMS:
        buckets = -(-n // BUCKET_ITEMS)
        ways = shards * -(-TOP_ITEMS // (shards * buckets))
        dealt = _dealt(items.withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(buckets))), "_b", ways)
        level = stored(dealt.withColumn("_bin", F.concat_ws("-", "_bucket", "_way")), "bins")
        levels.append(level.select("_id", "_bin"))
        items = stored(level.groupBy("_bin").agg(F.sum("_bytes").alias("_bytes")).withColumnRenamed("_bin", "_id"), "bins")
    placed = stored(_dealt(items.withColumn("_b", F.lit(0).cast("long")), "_b", shards).select("_id", "_way"), "placed")
    for level in reversed(levels):
        bins = placed.withColumnRenamed("_id", "_bin")
        placed = lookup_join(level, bins, ["_bin"], "inner", spread=["_id"]).select("_id", "_way")
    return placed.withColumnRenamed("_way", "_shard")


def assign_shards(docs: DataFrame, shards: int = 24, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``, all by default) with size, text_crc32, law, shard, slot and grown_shard.

    A slot is a row's place in its shard, in order of the rows' group and columns.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    kept = without(docs, RESULTS).columns if keep is None else keep
    rows = docs.select(
        packed(kept),
        (F.length(body) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        F.when(F.col(f"`{text}`").isNull(), F.lit("-")).otherwise(F.concat_ws(".", F.xxhash64(body), F.length(body))).alias("_id"),
    )
    rows = stored(rows, "rows")
    groups = stored(rows.groupBy("_id").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows")), "groups")
    placed = stored(group_shards(groups, shards), "group_shards")
    dealt = hot_join(rows, placed, ["_id"], groups.select("_id", "_rows"))
    order = [F.col("_shard"), F.col("_id"), *[F.col("_user").getField(c) for c in kept if c != text]]
    numbered = with_running_totals(dealt, order, {"_place": F.lit(1).cast("long")})
    firsts = numbered.groupBy("_shard").agg(F.min("_place").alias("_first"))
    return numbered.join(F.broadcast(firsts), "_shard").select(
        *unpacked(kept),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_place") - F.col("_first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
