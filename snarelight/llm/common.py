"""Helpers shared by the text operators: column clashes, running totals, hot keys, text slices."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snarelight.operators.skew import is_small, lookup_join
from snarelight.session import discard, settings, stored

#: Words are runs of anything but these six white space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text bytes an executor's Python task works on at a time.
SLICE_BYTES = 8 << 20
#: Bytes of the rows that Spark hands to a Python task at a time, under ``small_batches``.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowered(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns that results of these names would clash with, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def packed(names: list[str]) -> Column:
    """The user's columns of these names as one struct ``_user``: no name in it can clash with a work column."""
    return F.struct(*[F.col(f"`{c}`") for c in names] or [F.lit(None).alias("none")]).alias("_user")


def unpacked(names: list[str]) -> list[Column]:
    return [F.col("_user").getField(c).alias(c) for c in names]


def shielded(df: DataFrame, text: str, **more: str) -> DataFrame:
    """``_user`` (all columns but the text), ``text``, and further columns under plain names: nothing else that could clash."""
    others = [c for c in df.columns if c != text]
    return df.select(packed(others), F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(n) for n, c in more.items()])


def restored(names: list[str], text: str) -> list[Column]:
    """The user's columns of these names, the text among them."""
    return [F.col("text").alias(c) if c == text else F.col("_user").getField(c).alias(c) for c in names]


def with_running_totals(df: DataFrame, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """Adds, for each entry of ``totals``, the sum of the column over all rows before this one in ``order``.

    Rows are range-partitioned by ``order``, so no group is large for a task; a row's total is the
    one within its partition plus those of the partitions before. Rows equal in all of ``order``
    get an arbitrary but stored order.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(
        placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranged"
    )
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in totals.items()])
    # One row per partition: the single-task window and the broadcast are bounded.
    starts = sums.select("_part", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in totals])
    inside = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    out = ranged
    for n, c in totals.items():
        out = out.withColumn(n, F.coalesce(F.sum(c).over(inside), F.lit(0)))
    out = out.join(F.broadcast(starts), "_part")
    for n in totals:
        out = out.withColumn(n, F.col(n) + F.col(f"_b_{n}"))
    return out.drop("_part", "_at", *[f"_b_{n}" for n in totals])


def hot_join(many: DataFrame, one: DataFrame, keys: list[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """``many`` joined to its unique ``one``; keys with far more rows than a task's share are salted.

    ``counts`` has the keys and ``_rows``, the rows of each key in ``many``. A key is hot above a
    quarter of a task's share, so there are at most 4 x partitions hot keys.
    """
    if is_small(one):
        return many.join(F.broadcast(one), keys, how)
    parts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    share = max(64, total // (4 * parts))
    hot = F.broadcast(counts.where(F.col("_rows") > share).select(*keys, F.ceil(F.col("_rows") / share).alias("_salts")))
    # A row's salt follows from the row, so a task that runs again deals its rows alike.
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in many.columns]), F.col("_salts"))
    spread = many.join(hot, keys, "left").withColumn("_salt", F.coalesce(salt, F.lit(0)).cast("long"))
    last = F.coalesce(F.col("_salts"), F.lit(1)).cast("long") - 1
    copied = one.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("_salts")
    return spread.drop("_salts").join(copied, [*keys, "_salt"], how).drop("_salt")


#: Bits of a key filter: 8 MB, whatever the number of keys.
FILTER_BITS = 1 << 26


def key_filter(keys: DataFrame, column: str, each: int = 1) -> bytes:
    """A bitmap with ``each`` (1 or 2) bits of each key (a long) set: what is not in it is none of ``keys``.

    Its size is fixed. With very many keys it fills up and lets everything through; an exact join
    has to follow in any case. A second bit, of the key's upper half, lets fewer others through
    while there are fewer keys than about half the bits; keys have to be digests for it.
    """
    bits = [F.pmod(F.shiftright(column, 32 * k) if k else F.col(column), F.lit(FILTER_BITS)) for k in range(each)]
    bit = F.col("bit")
    rows = keys.select(bits[0].alias("bit") if each == 1 else F.explode(F.array(*bits)).alias("bit"))
    words = rows.select((bit / 32).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 32).cast("int")).alias("b"))
    # Stored first: a table's shuffle files go with its writing, those of a collected result stay for long.
    found = stored(words.groupBy("w").agg(F.bit_or("b").alias("b")), "bits")
    rows = found.toArrow()
    discard(found)
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[rows.column("w").to_numpy()] = rows.column("b").to_numpy().astype(np.uint32)
    return bits.tobytes()


def may_hold(bitmap: bytes, keys: np.ndarray, each: int = 1) -> np.ndarray:
    words, held = np.frombuffer(bitmap, np.uint32), True
    for k in range(each):
        bit = np.mod(keys >> (32 * k), len(words) * 32)
        held = held & ((words[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1)
    return held


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """In the block, rows go to Python tasks in batches of about BATCH_BYTES.

    Ten thousand texts (Spark's default) or as many sets are tens of MB, several times over in JVM and Python.
    """
    return settings(spark, spark_sql_execution_arrow_maxBytesPerBatch=str(BATCH_BYTES))


def arrow_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about ``most`` bytes of its ``column``-th column (strings)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
        piece = np.cumsum(size) // most
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [len(size)]])
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if end > start:
                # A copy: splitting texts of a slice with an offset loses words.
                yield batch.take(pa.array(np.arange(start, end)))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (large strings), and the number of words of each text."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    words, of = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), np.bincount(of.filter(full).to_numpy(), minlength=len(texts))


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The batches cut so that each has about SLICE_BYTES of ``column``; with its values as bytes or None."""
    for batch in batches:
        for piece in arrow_slices([batch], batch.schema.get_field_index(column)):
            yield piece, piece.column(column).cast(pa.binary()).to_pylist()


__all__ = [
    "BATCH_BYTES", "FILTER_BITS", "LOWER", "SPACES", "UPPER", "WORD", "arrow_slices", "hot_join", "is_small", "key_filter", "lookup_join", "lowered", "may_hold", "packed", "restored", "shielded", "slices", "small_batches", "split_words", "stored",
    "table", "unpacked", "with_running_totals", "without",
]
