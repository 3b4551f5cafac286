"""Near duplicates of embeddings by cosine: tiles compared along principal components.

Equal vectors are one entry. Unit vectors are turned to the principal components of all entries, so
that the leading dimensions carry most of their length, and sorted by the first one into blocks.
Two blocks are compared tile by tile in a task of its own, unless their ranges of the first
component are too far apart. Within a tile the products of the leading dimensions come first; the rest
can't add more than the product of both suffix norms, which is one more column of the same matrix
product. Pairs that can still reach the threshold go on with the next dimensions, bounded in the
same way, to the last. What comes within ``SLACK`` of the threshold is decided on the given vectors.

A task emits no pairs: for each entry the number of vectors it is linked with, and one link to the root
of its component within the two blocks; components are those of these links. Comparing all rows with
all takes time of n squared over the number of cores; only (blocks + 1) / 2 copies of the vectors
are shuffled, and there are at most ``MOST_BLOCKS`` blocks.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do
vectors of different lengths with each other. The principal components are those of the most
frequent length (up to ``MOST_DIMENSIONS``); vectors of other lengths are compared along their own
axes. Rows are vectors: repeated rows and ids are linked like others. A null id is larger than any;
a component without any id has a null component_id, which counts as equal to null ids. Empty tables give empty
results. Input columns with the name of a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snarelight.llm.common import hot_join, packed, stored, unpacked, without
from snarelight.llm.components import components
from snarelight.operators.positions import with_index

THRESHOLD = 0.9
TILE = 1024
#: A block has at most so many bytes of doubles, unless that makes more than MOST_BLOCKS blocks.
BLOCK_BYTES, MOST_BLOCKS = 32 << 20, 4096
MOST_DIMENSIONS = 2048
#: Rounding of products of unit vectors stays far below.
SLACK = 1e-9
#: Pairs followed one by one at a time, and the share of a tile above which it is multiplied as a whole.
PAIRS, DENSE = 32_768, 0.05
RESULTS = ["n_links", "component_id", "kept"]


def _vectors(given: DataFrame, vector: str, vec_id: str, keep: list[str]) -> DataFrame:
    """_user (the columns ``keep``), vec_id and _v (bytes of the components as doubles; null: not usable)."""
    rows = given.select(
        packed(keep),
        F.col(f"`{vec_id}`").alias("vec_id"),
        F.col(f"`{vector}`").cast("array<double>").alias("given"),
        F.lit(None).cast("binary").alias("_v"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column("given")
            offsets = given.offsets.to_numpy()
            values = given.values.to_numpy(zero_copy_only=False).astype(float)  # null components become NaN
            out = np.full(len(given), None, object)
            size = np.where(given.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
            for n in np.unique(size[size > 0]).tolist():
                own = np.flatnonzero(size == n)
                table = values[offsets[own][:, None] + np.arange(n)] + 0.0  # -0.0 is 0.0
                fine = np.isfinite(table).all(1) & table.any(1)
                for k, x in zip(own[fine], table[fine], strict=True):
                    out[k] = x.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.nulls(len(given), given.type), pa.array(out, pa.binary())], schema=batch.schema
            )

    return rows.mapInArrow(run, rows.schema).drop("given")


def units(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square leaves the range of doubles."""
    scaled = raw / np.abs(raw).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


@dataclass(frozen=True)
class Axes:
    """Principal components of the vectors of one length (columns, by falling share of the whole), and where to stop and look."""

    dimensions: int
    basis: np.ndarray
    first: int

    def turned(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.basis if unit.shape[1] == self.dimensions else unit

    def cuts(self, dimensions: int) -> list[int]:
        """The first cut, then doubled up to all dimensions."""
        cut, out = self.first if dimensions == self.dimensions else max(1, dimensions // 4), []
        while cut < dimensions:
            out.append(cut)
            cut *= 2
        return [*out, dimensions]


def principal_axes(entries: DataFrame, threshold: float) -> Axes:
    """From the sum of outer products of all unit vectors of the most frequent length."""
    sizes = entries.groupBy((F.length("_v") / 8).cast("int").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.where(F.col("d") <= MOST_DIMENSIONS).orderBy(F.desc("n"), "d").first()
    if common is None:
        return Axes(0, np.zeros((0, 0)), 1)
    d = common["d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = units(np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(-1, d))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "row"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(r) for r in rows.column("row").to_pylist()], axis=0)
        return pa.table({"i": rows.column("i")[:1], "row": pa.array([total.tobytes()], pa.binary())})

    partial = entries.where(F.length("_v") == 8 * d).select("_v").mapInArrow(run, "i int, row binary")
    rows = sorted(partial.groupBy("i").applyInArrow(add, "i int, row binary").collect())
    share, basis = np.linalg.eigh(np.stack([np.frombuffer(r["row"]) for r in rows]))
    share, basis = share[::-1] / share.sum(), np.ascontiguousarray(basis[:, ::-1])
    # After the first cut the typical bound, the share that is left, is well below the threshold.
    first = int(np.searchsorted(np.cumsum(share), 1 - max(threshold - 0.15, 0.05))) + 1
    return Axes(d, basis, min(first, d))


class Block:
    """Entries of one length in the order of their first component."""

    def __init__(self, raw: np.ndarray, axes: Axes) -> None:
        self.raw = raw
        turned = axes.turned(units(raw))
        order = np.argsort(turned[:, 0], kind="stable")
        self.order, self.turned = order, turned[order]
        self.cuts = axes.cuts(raw.shape[1])
        # Lengths of what follows each cut, as columns; summed from the smallest on.
        squares = np.cumsum((self.turned * self.turned)[:, ::-1], axis=1)[:, ::-1]
        self.rest = np.sqrt(np.stack([squares[:, c] for c in self.cuts[:-1]], 1)) if len(self.cuts) > 1 else np.zeros((len(raw), 0))
        self.lead = np.hstack([self.turned[:, : self.cuts[0]], self.rest[:, :1]])


def tile_pairs(a: Block, rows: slice, b: Block, columns: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers (within the tile) of the pairs at the threshold or above."""
    least = threshold - SLACK
    bound = a.lead[rows] @ b.lead[columns].T
    i, j = np.nonzero(bound >= least)
    if len(i) > DENSE * bound.size:
        product = a.turned[rows] @ b.turned[columns].T
        i, j = np.nonzero(product >= least)
        value = product[i, j]
    else:
        found = [_followed(a, rows, b, columns, i[k : k + PAIRS], j[k : k + PAIRS], bound, least) for k in range(0, len(i), PAIRS)]
        i, j, value = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (i, j, np.zeros(0))
    near = np.flatnonzero(value < threshold + SLACK)
    if len(near):
        x = units(a.raw[a.order[rows][i[near]]])
        y = units(b.raw[b.order[columns][j[near]]])
        keep = np.ones(len(i), bool)
        keep[near] = (x * y).sum(1) >= threshold
        i, j = i[keep], j[keep]
    return i, j


def _followed(a, rows, b, columns, i, j, bound, least) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that stay possible after every cut, with their whole products."""
    first = a.cuts[0]
    value = bound[i, j] - (a.rest[rows][i, 0] * b.rest[columns][j, 0] if len(a.cuts) > 1 else 0.0)
    for k, cut in enumerate(a.cuts[1:], 1):
        value = value + np.einsum("pd,pd->p", a.turned[rows][i, first:cut], b.turned[columns][j, first:cut])
        first = cut
        most = value + a.rest[rows][i, k] * b.rest[columns][j, k] if k < len(a.cuts) - 1 else value
        open_ = most >= least
        i, j, value = i[open_], j[open_], value[open_]
    return i, j, value


def joined(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component labels (smallest member, each member's own) after linking i with j."""
    while True:
        apart = labels[i] != labels[j]
        if not apart.any():
            return labels
        i, j = i[apart], j[apart]
        low, high = np.minimum(labels[i], labels[j]), np.maximum(labels[i], labels[j])
        np.minimum.at(labels, high, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def compared(v: list[bytes], copies: np.ndarray, second: np.ndarray, axes: Axes, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Per entry of one or two blocks: vectors linked with it and its label. ``second`` tells the blocks apart.

    Within one block (no ``second`` at all) all pairs are compared, otherwise those between the blocks.
    """
    links, labels = np.zeros(len(v), np.int64), np.arange(len(v))
    size = np.array([len(x) for x in v])
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    for n in np.unique(size).tolist():
        sides = [np.flatnonzero((size == n) & (second == s)) for s in (False, True)]
        if not len(sides[0]) or (second.any() and not len(sides[1])):
            continue
        blocks = [Block(np.frombuffer(b"".join(v[k] for k in own)).reshape(len(own), -1), axes) for own in sides if len(own)]
        a, b = blocks[0], blocks[-1]
        of_a, of_b = sides[0][a.order], (sides[1] if len(sides[1]) else sides[0])[b.order]
        for s in range(0, len(of_a), TILE):
            rows = slice(s, s + TILE)
            low, high = a.turned[rows][0, 0] - reach, a.turned[rows][-1, 0] + reach
            for t in range(s if a is b else 0, len(of_b), TILE):
                columns = slice(t, t + TILE)
                if b.turned[columns][0, 0] > high:
                    break
                if b.turned[columns][-1, 0] < low:
                    continue
                i, j = tile_pairs(a, rows, b, columns, threshold)
                if a is b and s == t:
                    i, j = i[i < j], j[i < j]
                i, j = of_a[rows][i], of_b[columns][j]
                links += np.bincount(i, copies[j], len(v)).astype(np.int64) + np.bincount(j, copies[i], len(v)).astype(np.int64)
                labels = joined(labels, i, j)
    return links, labels


def _block_rows(n: int, widest: int, cores: int) -> int:
    """So many blocks that their pairs keep the cores busy, within the bounds on a block's bytes and the number of blocks."""
    busy = -(-n // max(1, int(np.ceil(np.sqrt(8 * cores)))))
    return max(1, -(-n // MOST_BLOCKS), min(max(busy, TILE), BLOCK_BYTES // max(1, widest)))


def block_links(entries: DataFrame, axes: Axes, threshold: float) -> DataFrame:
    """id, links and root: per pair of blocks, the entries with links. ``entries`` has id, _v and copies."""
    spark = entries.sparkSession

    def first_component(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(x) // 8 for x in batch.column("_v").to_pylist()])
            values = np.frombuffer(b"".join(batch.column("_v").to_pylist()))
            starts, out = np.cumsum(lengths) - lengths, np.zeros(len(lengths))
            for n in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == n)
                out[own] = axes.turned(units(values[starts[own][:, None] + np.arange(n)]))[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths, pa.int32()), pa.array(out)], names=[*batch.schema.names, "d", "c"])

    rows = entries.select("id", "copies", "_v").mapInArrow(first_component, "id bigint, copies bigint, _v binary, d int, c double")
    placed = with_index(rows, [F.col("d"), F.col("c"), F.col("id")], "place")
    n, widest = placed.agg(F.count(F.lit(1)), F.coalesce(F.max("d"), F.lit(1))).first()
    size = _block_rows(n, 8 * widest, spark.sparkContext.defaultParallelism)
    placed = placed.withColumn("block", F.floor(F.col("place") / size))
    # At most MOST_BLOCKS rows.
    blocks = placed.groupBy("block").agg(F.min("d"), F.max("d"), F.min("c"), F.max("c")).orderBy("block").collect()
    ranges, pairs = [], 0
    if blocks:
        _, low_d, high_d, low, high = (np.array(x) for x in zip(*blocks, strict=True))
        reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
        for k in range(len(blocks)):
            # A block of several lengths has several ranges of the component: it is compared with all that share one.
            mixed = (low_d != high_d) | (low_d[k] != high_d[k])
            meets = (low_d <= high_d[k]) & (high_d >= low_d[k]) & (mixed | ((low <= high[k] + reach) & (high >= low[k] - reach)))
            near = np.flatnonzero(meets)
            ranges.append((k, int(near[0]), int(near[-1])))
            pairs += int(near[-1]) - k + 1
    near = spark.createDataFrame(ranges, "block bigint, low bigint, high bigint")
    dealt = placed.drop("place", "d", "c").join(F.broadcast(near), "block").withColumn("other", F.explode(F.sequence("low", "high")))
    dealt = dealt.select(
        F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "copies", "_v"
    )
    tasks = max(1, min(2 * pairs, 16 * spark.sparkContext.defaultParallelism, 100_000))

    def compare(rows: pa.Table) -> pa.Table:
        second = rows.column("block").to_numpy() != rows.column("x")[0].as_py()
        if rows.column("x")[0] != rows.column("y")[0] and (second.all() or not second.any()):
            return pa.table({k: pa.array([], pa.int64()) for k in ("id", "links", "root")})
        ids = rows.column("id").to_numpy()
        links, labels = compared(rows.column("_v").to_pylist(), rows.column("copies").to_numpy(), second, axes, threshold)
        linked = links > 0
        return pa.table({"id": ids[linked], "links": links[linked], "root": ids[labels[linked]]})

    return dealt.repartition(tasks, "x", "y").groupBy("x", "y").applyInArrow(compare, "id bigint, links bigint, root bigint")


def near_vectors(
    vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", keep: list[str] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """Columns ``keep`` of ``vectors`` (default: all but the vector) with n_links, component_id and kept.

    n_links counts the other rows with a cosine of ``threshold`` (above 0, at most 1) or more; component_id is the smallest id
    reachable by links; kept marks the rows with that id.
    """
    kept = [c for c in without(vectors, RESULTS).columns if c != vector] if keep is None else keep
    found = stored(_vectors(vectors, vector, vec_id, kept), "vectors")
    usable = found.where("_v is not null")
    entries = usable.groupBy("_v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    entries = stored(entries.withColumn("id", F.monotonically_increasing_id()), "entries")
    pieces = stored(block_links(entries, principal_axes(entries, threshold), threshold), "block-links")
    totals = pieces.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(pieces.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    marked = entries.join(totals, "id", "left").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    # Copies of a vector are linked with each other, too.
    marked = marked.select("_v", "copies", "label", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    marked = stored(marked, "marked")
    groups = marked.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_rows"))
    named = hot_join(marked, groups.drop("_rows"), ["label"], groups.select("label", "_rows")).select("_v", "n_links", "component_id")
    full = hot_join(usable, named, ["_v"], marked.select("_v", F.col("copies").alias("_rows")))
    alone = found.where("_v is null").withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id")})
    return full.unionByName(alone).select(
        *unpacked(kept), F.col("n_links").cast("long"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
