"""N-gram Jaccard join over count vectors in R-trees.

A document's set is its distinct shingles of ``size`` words; sets link at a Jaccard of ``part`` of ``WHOLE`` or more
(defaults: ``SHINGLE`` and ``PART``). Hashing shingles into groups gives a
point, the counts per group; two sets share at most the sum over groups of the smaller count.
Documents whose sets are equal become one entry. Entries meet where they share a shingle among their
first (n - ceil(t n) + 1) in one global order: two sets with Jaccard t must. What meets in such a
place is indexed in an R-tree over the points, whose nodes hold the largest count per group and the
set sizes below them; a search keeps what the summed minima allow, and only surviving pairs are
verified on the whole sets.

Pairs in a place number its square, so a first round emits only a spanning forest of the surviving
pairs, and links them up to components. All surviving pairs of a place lie in its forest's trees, so
only places whose trees still span several components are left; a second round searches their trees'
entries again, with the whole sets, and emits the links that join components. Either a pair is
verified or its ends are connected already, so components are exact, and no round emits more pairs
than entries in its places. Places of more than ``PLACE`` entries are dealt to blocks and searched block by block. The
global order puts shingles of frequent words last; it affects speed only.

Null and empty texts have no set and link with nothing; a text with fewer words than a shingle is one
shingle; repeated rows are equal documents. Empty tables give empty results. Texts are used whole.
Input columns with the name of a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snarelight.llm.common import arrow_slices, hot_join, key_filter, lookup_join, may_hold, packed, small_batches, split_words, stored, unpacked, without
from snarelight.llm.components import components
from snarelight.session import new_folder, temporary_folders

SHINGLE = 3
#: The default link threshold as a fraction: 90 of 100.
PART, WHOLE = 90, 100
PLACE = 4096
#: Words that may be ordered by their frequency: those with this share of some slice of texts, at most so many.
COMMON_SHARE, COMMON_WORDS = 2.0**-14, 65_536
#: Text bytes made into sets at a time.
TASK_BYTES = 2 << 20
#: Groups of a point, for sets up to SMALL_SET and beyond. The second is a multiple of the first.
GROUPS, MORE_GROUPS, SMALL_SET = 32, 128, 1024
#: Finer groups of which only the parity of the count is kept: more than the set has shingles, within these bounds.
FEWEST_BITS, MOST_BITS = 512, 1 << 14
LEAF = 32
#: Shingles of a block in the second round.
BLOCK_SHINGLES = 2 << 20
RESULTS = ["n_shingles", "component_id"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def shingle_sets(texts: pa.Array, costs: dict[bytes, int], size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct shingles of each text, as sorted 64-bit hashes, and the sums of their words' ``costs``."""
    words, counts = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = words.dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
    numbers = coded.indices.to_numpy()
    flat = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))[numbers]
    cost = np.fromiter((costs.get(w, 0) for w in distinct), np.int64, len(distinct))[numbers]
    odd = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]

    def shingles(n: int) -> tuple[np.ndarray, np.ndarray]:
        rolled, costs = np.full(max(0, len(flat) - n + 1), n, np.uint64), np.zeros(max(0, len(flat) - n + 1), np.int64)
        for k in range(n if len(rolled) else 0):
            rolled = _mixed((rolled ^ flat[k : len(flat) - n + 1 + k]) * odd[k % 4] + np.uint64(k + 1))
            costs += cost[k : len(cost) - n + 1 + k]
        return rolled, costs

    by_size = {n: shingles(n) for n in {min(c, size) for c in counts.tolist()} if n}
    out, at = [], 0
    for count in counts.tolist():
        n = min(count, size)
        if n:
            rolled, own = (x[at : at + count - n + 1] for x in by_size[n])
            found, first = np.unique(rolled, return_index=True)
            out.append((found, own[first]))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        at += count
    return out


def prefix_size(n: int, part: int = PART) -> int:
    return n - -(-n * part // WHOLE) + 1


def parity_bits(n: int) -> int:
    """The least power of two above n, within the bounds: places of long sets would otherwise pass every pair."""
    return min(MOST_BITS, max(FEWEST_BITS, 1 << int(n).bit_length()))


def point_of(shingles: np.ndarray) -> bytes:
    """The parities of the counts in the finer groups as bits, then the counts per group."""
    groups, finer = GROUPS if len(shingles) <= SMALL_SET else MORE_GROUPS, parity_bits(len(shingles))
    fine = np.bincount((shingles & np.uint64(finer - 1)).astype(np.int64), minlength=finer)
    counts = fine.reshape(-1, groups).sum(0)
    bits = np.packbits((fine & 1).astype(np.uint8))
    return bits.tobytes() + counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def points(raw: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The counts per group as rows, folded to the fewer groups where sets of both kinds meet."""
    rows = []
    for b, n in zip(raw, sizes, strict=True):
        groups, cut = GROUPS if n <= SMALL_SET else MORE_GROUPS, parity_bits(n) // 8
        rows.append(np.frombuffer(b, np.uint8 if len(b) == cut + groups else np.uint32, groups, cut).astype(np.int32))
    least = min(map(len, rows))
    return np.stack([r if len(r) == least else r.reshape(-1, least).sum(0) for r in rows])


class Parities:
    """The parity bits of a place's entries. Two entries are compared at the smaller one's number of bits."""

    def __init__(self, raw: list[bytes], sizes: np.ndarray, part: int = PART) -> None:
        self.sizes, self.part = sizes, part
        self.widths = np.array([parity_bits(n) // 8 for n in sizes])
        self.raw = [np.frombuffer(b, np.uint8, w) for b, w in zip(raw, self.widths.tolist(), strict=True)]
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each entry's row is, and the rows of all entries of at least this width, folded to it."""
        if width not in self.folded:
            wide = np.flatnonzero(self.widths >= width)
            where = np.zeros(len(self.raw), np.int64)
            where[wide] = np.arange(len(wide))
            rows = [np.bitwise_xor.reduce(self.raw[i].reshape(-1, width), 0) for i in wide.tolist()]
            self.folded[width] = where, np.stack(rows).view(np.uint64)
        return self.folded[width]

    def close(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which sets may differ from the i-th by as few shingles as the threshold allows: unequal parities are differences."""
        apart = np.zeros(len(others), np.int64)
        widths = np.minimum(self.widths[others], self.widths[i])
        for width in set(widths.tolist()):
            mine = widths == width
            where, rows = self.at(width)
            apart[mine] = np.bitwise_count(rows[where[others[mine]]] ^ rows[where[i]]).sum(1, dtype=np.int64)
        return (WHOLE + self.part) * apart <= (WHOLE - self.part) * (self.sizes[i] + self.sizes[others])


class RTree:
    """Points packed by size and coordinates; nodes hold the largest counts and the range of sizes."""

    def __init__(self, table: np.ndarray, sizes: np.ndarray, part: int = PART) -> None:
        self.part = part
        order = np.lexsort((*table[:, :3].T, sizes))
        self.order, self.table, self.sizes = order, table[order], sizes[order]
        self.levels = []
        top, low, high = self.table, self.sizes, self.sizes
        while len(low) > 1:
            cuts = np.arange(0, len(low), LEAF)
            top = np.maximum.reduceat(top, cuts)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high))

    @staticmethod
    def may_link(point, n, top, low, high, part=PART) -> np.ndarray:
        """Whether entries with at most these counts and sizes in low..high may reach the threshold."""
        shared = np.minimum(top, point).sum(1)
        fits = (high * WHOLE >= n * part) & (low * part <= n * WHOLE)
        # Jaccard >= t: (whole + part) * shared >= part * (sum of sizes); the least size allowed bounds the sum.
        least = np.maximum(low, -(-n * part // WHOLE))
        return fits & ((WHOLE + part) * shared >= part * (n + least))

    def search(self, point: np.ndarray, n: int) -> np.ndarray:
        """Entries (numbers as given) that may link with a set of n shingles at ``point``."""
        nodes = np.zeros(1, np.int64)
        for top, low, high in reversed(self.levels[:-1]):
            children = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            children = children[children < len(low)]
            nodes = children[self.may_link(point, n, top[children], low[children], high[children], self.part)]
        if self.levels:
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < len(self.sizes)]
        hit = nodes[self.may_link(point, n, self.table[nodes], self.sizes[nodes], self.sizes[nodes], self.part)]
        return self.order[hit]


def linked(mine: np.ndarray, others: list[np.ndarray], part: int = PART) -> np.ndarray:
    """Which of the other sets (sorted, not empty) link with mine."""
    if not others:
        return np.zeros(0, bool)
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    hits = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
    shared = np.add.reduceat(hits.astype(np.int64), np.cumsum(sizes) - sizes)
    return (WHOLE + part) * shared >= part * (len(mine) + sizes)


def place_links(
    ids: np.ndarray, sizes: np.ndarray, raw: list[bytes], labels: np.ndarray | None, part: int = PART, sets: list[np.ndarray] | None = None
) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of one place that may link, or with ``labels`` and ``sets`` of the links between labels."""
    if labels is not None and (labels == labels[0]).all():
        return []
    table, parities = points(raw, sizes), Parities(raw, sizes, part)
    if len(ids) == 2 and sets is None:
        fits = RTree.may_link(table[0], sizes[0], table[1:], sizes[1:], sizes[1:], part)
        if (fits & parities.close(0, np.ones(1, np.int64)))[0]:
            return [(int(ids[0]), int(ids[1]))]
        return []
    tree = RTree(table, sizes, part)
    own = list(range(len(ids))) if labels is None else np.unique(labels, return_inverse=True)[1].tolist()
    out, root = [], list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(1, len(ids)):
        near = tree.search(table[i], sizes[i])
        # Smallest first: places with the same entries then emit the same pairs.
        near = np.sort(near[near < i])
        near = near[parities.close(i, near)]
        if sets is not None:
            near = near[[find(own[j]) != find(own[i]) for j in near.tolist()]] if len(near) else near
            near = near[linked(sets[i], [sets[j] for j in near.tolist()], part)]
        for j in near.tolist():
            if (a := find(own[i])) != (b := find(own[j])):
                root[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[j])))
    return out


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _fingerprints(docs: DataFrame, text: str, doc_id: str, keep: list[str], costs: dict[bytes, int], size: int, part: int) -> DataFrame:
    """_user (``keep``) and doc_id with n_shingles, _set (digest of the set; null: empty), _text (hash of the text), _prefix and _point."""
    rows = docs.select(
        F.col(f"`{text}`").cast("string").alias("_body"),
        packed(keep),
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.lit(0).cast("long").alias("n_shingles"),
        F.xxhash64(F.col(f"`{text}`")).alias("_text"),
        F.lit(None).cast("binary").alias("_set"),
        F.array().cast("array<bigint>").alias("_prefix"),
        F.lit(None).cast("binary").alias("_point"),
    )
    sent = docs.sparkSession.sparkContext.broadcast(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, 0, TASK_BYTES):
            sets = shingle_sets(batch.column(0), sent.value, size)
            made = {
                "_body": pa.nulls(len(batch), pa.string()),
                "n_shingles": pa.array([len(s) for s, _ in sets], pa.int64()),
                "_set": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s, _ in sets], pa.binary()),
                # One global order: what is made of rare words first, then by hash.
                "_prefix": _lists([s[np.lexsort((s, c))[: prefix_size(len(s), part)]] if len(s) else s for s, c in sets]),
                "_point": pa.array([point_of(s) if len(s) else None for s, _ in sets], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(
                [made.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)], names=batch.schema.names
            )

    return rows.mapInArrow(run, rows.schema).drop("_body")


def _word_costs(docs: DataFrame, text: str) -> dict[bytes, int]:
    """Costs of the words most frequent in all documents: an order for speed, no filter.

    A slice of texts reports the words that make up ``COMMON_SHARE`` of it, so what is shuffled is bounded by the number of slices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, 0):
            words, _ = split_words(pc.ascii_lower(pc.fill_null(batch.column(0), "")))
            counts = words.value_counts()
            often = pc.greater_equal(counts.field("counts"), max(2, int(COMMON_SHARE * len(words))))
            columns = [counts.field("values").filter(often).cast(pa.binary()), counts.field("counts").filter(often)]
            yield pa.RecordBatch.from_arrays(columns, names=["w", "n"])

    counts = docs.select(F.col(f"`{text}`").cast("string").alias("_body")).mapInArrow(run, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "w").limit(COMMON_WORDS).toArrow()
    logs = np.rint(4 * np.log2(rows.column("n").to_numpy().astype(float))).astype(int).tolist()
    return dict(zip(rows.column("w").to_pylist(), logs, strict=True))


def _by_place(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """The places (three columns) of sorted rows, each with the lists of its other columns."""
    held = None
    for batch in batches:
        columns = [_values(batch.column(c)) for c in names]
        key = list(zip(*columns[:3], strict=True))
        cuts = [0] + [i for i in range(1, len(key)) if key[i] != key[i - 1]] + [len(key)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            place = (key[s], [c[s:e] for c in columns[3:]])
            if held and held[0] == place[0]:
                for mine, more in zip(held[1], place[1], strict=True):
                    mine += more
                continue
            if held:
                yield held
            held = place
    if held:
        yield held


def _values(column: pa.Array) -> list:
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    flat, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy().tolist()
    return [flat[s:e] for s, e in zip(ends, ends[1:], strict=False)]


def _in_batches(rows: Iterator[tuple[int, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], names=names)


def _forests(places: DataFrame, part: int) -> DataFrame:
    """token, x, y, a and b: in each place, a spanning forest of the pairs that may link.

    ``places`` has token, x and y (block numbers), id, n and point.
    """
    names, made = ["token", "x", "y", "id", "n", "point"], ["token", "x", "y", "a", "b"]
    rows = places.select(*names).repartition("token", "x", "y").sortWithinPartitions("token", "x", "y", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (
            (*key, min(a, b), max(a, b))
            for key, (ids, sizes, raw) in _by_place(batches, names)
            if len(ids) > 1
            for a, b in place_links(np.array(ids), np.array(sizes), raw, None, part)
        )
        yield from _in_batches(found, made)

    return rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in made))


def _open_places(forests: DataFrame, labels: DataFrame) -> DataFrame:
    """place and id of what may still link entries of different components.

    All pairs of a place that may link lie in trees of its forest. Where the ends of every tree's pairs have one
    label by now, no pair is left; elsewhere the trees' entries are searched again. Places with the same entries are one.
    """
    key = ["token", "x", "y"]
    of = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"_{name}"))
    named = forests.join(of("a"), "a", "left").join(of("b"), "b", "left")
    differ = named.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select(*key).distinct()
    left = forests.join(stored(differ, "open"), key, "left_semi")
    ends = stored(left.select(*key, F.col("a").alias("id")).union(left.select(*key, "b")).distinct(), "ends")
    member = F.xxhash64("id")
    digests = ends.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor(member).alias("_x"), F.sum(member.bitwiseAND((1 << 40) - 1)).alias("_y")
    )
    one = digests.groupBy("_n", "_x", "_y").agg(F.min(F.struct(*key)).alias("_key")).select("_key.*")
    return stored(ends.join(stored(one.withColumn("place", F.monotonically_increasing_id()), "places"), key).select("place", "id"), "members")


def _joined_up(members: DataFrame, entries: DataFrame, labels: DataFrame, sets: DataFrame, part: int) -> DataFrame:
    """a and b: verified links that join all components which links within a place of ``members`` connect.

    The sets come along, so no pair leaves a task unless it joins two components. Places are dealt to blocks by the
    shingles they hold.
    """
    known = members.join(entries.select("id", F.col("n_shingles").alias("n"), F.col("_point").alias("point")), "id")
    blocks = known.groupBy("place").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("_blocks"))
    known = known.join(blocks, "place").withColumn("_mine", F.pmod(F.xxhash64("id"), F.col("_blocks")))
    known = known.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    known = known.withColumns({"x": F.least("_mine", "_other"), "y": F.greatest("_mine", "_other")})
    named = known.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    names = ["place", "x", "y", "id", "n", "point", "label", "shingles"]
    rows = named.join(sets, "id").select(*names).repartition("place", "x", "y").sortWithinPartitions("place", "x", "y", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (
            (min(a, b), max(a, b))
            for _, (ids, sizes, raw, own, shingles) in _by_place(batches, names)
            if len(ids) > 1
            for a, b in place_links(np.array(ids), np.array(sizes), raw, np.array(own), part, shingles)
        )
        yield from _in_batches(found, ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _sets_of(ids: DataFrame, entries: DataFrame, docs: DataFrame, text: str, size: int) -> DataFrame:
    """id and shingles of the entries in question. Sets are made again, for their texts only."""
    wanted = stored(ids.distinct().join(entries.select("id", "_text", "_set"), "id"), "wanted")
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(wanted, "_text"))
    body = F.col(f"`{text}`")
    rows = docs.select(body.cast("string").alias("_body"), F.xxhash64(body).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(bits.value, batch.column("_text").to_numpy())))
            for piece in arrow_slices([batch], 0, TASK_BYTES):
                sets = [s for s, _ in shingle_sets(piece.column(0), {}, size)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(1), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), _lists(sets)],
                    names=["_text", "_set", "shingles"],
                )

    made = rows.mapInArrow(run, "_text bigint, _set binary, shingles array<bigint>")
    # Equal sets are interchangeable, so copies of a text are dropped before the join.
    made = made.dropDuplicates(["_set"]).drop("_text")
    return stored(wanted.select("id", "_set").join(made, "_set").select("id", "shingles"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, part: int) -> DataFrame:
    """The pairs whose sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("_sa", "_sb"))
    total = F.size("_sa") + F.size("_sb")
    return stored(both.where((WHOLE + part) * shared >= part * total).select("a", "b"), "linked")


def join_components(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, label: str | None = None,
    size: int = SHINGLE, part: int = PART,
) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all but the text) with n_shingles and component_id.

    component_id is the smallest doc_id of the documents connected by links; without a set, the own id.
    Sets are of shingles of ``size`` words and link at a Jaccard of ``part`` of ``WHOLE``.
    ``label`` names a column to add that tells components apart even where ids repeat (null: no set).
    """
    with small_batches(docs.sparkSession):
        return _join_components(docs, text, doc_id, keep, label, size, part)


def _join_components(
    docs: DataFrame, text: str, doc_id: str, keep: list[str] | None, label: str | None, size: int, part: int
) -> DataFrame:
    kept = [c for c in without(docs, RESULTS).columns if c != text] if keep is None else keep
    found = stored(_fingerprints(docs, text, doc_id, kept, _word_costs(docs, text), size, part), "fingerprints")
    with_set = found.where("_set is not null")
    copies = with_set.groupBy("_set").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_rows"))
    entries = with_set.select("_set", "_text", "n_shingles", "_prefix", "_point").dropDuplicates(["_set"])
    entries = stored(entries.withColumn("id", F.monotonically_increasing_id()), "entries")
    tokens = entries.select(F.explode("_prefix").alias("token"), "id")
    member = F.xxhash64("id")
    shared = tokens.groupBy("token").agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor(member).alias("_x"), F.sum(member.bitwiseAND((1 << 40) - 1)).alias("_y")
    )
    # Shingles with the same entries (equal counts and digests of ids) make one place.
    shared = shared.where("_n > 1").groupBy("_n", "_x", "_y").agg(F.min("token").alias("token")).select("token", "_n")
    met = stored(tokens.join(shared, "token"), "met")
    blocks = F.ceil(F.col("_n") / PLACE)
    mine = F.pmod(F.xxhash64("id"), blocks)
    met = met.join(entries.select("id", F.col("n_shingles").alias("n"), F.col("_point").alias("point")), "id")
    met = met.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    met = met.withColumns({"x": F.least("_mine", "_other"), "y": F.greatest("_mine", "_other")})
    forests = stored(_forests(met, part), "forests")
    first = stored(forests.select("a", "b").distinct(), "pairs")
    made = _sets_of(first.select(F.col("a").alias("id")).union(first.select("b")), entries, docs, text, size)
    links = _verified(first, made, part)
    labels = stored(components(links), "components")
    members = _open_places(forests, labels)
    # What is in a forest has its set made already.
    second = stored(_joined_up(members, entries, labels, made, part), "pairs")
    if not second.isEmpty():
        links = links.union(second)
        labels = stored(components(links), "components")
    sets = copies.join(entries.select("_set", "id"), "_set").join(labels.withColumnRenamed("node", "id"), "id", "left")
    sets = stored(sets.withColumn("label", F.coalesce("label", "id")), "sets")
    least = sets.groupBy("label").agg(F.min("_least").alias("component_id"))
    named_sets = sets.join(least, "label").select("_set", "component_id", F.col("label").alias("_component"))
    empty = found.where("_set is null").withColumn("component_id", F.col("doc_id")).withColumn("_component", F.lit(None).cast("long"))
    full = hot_join(with_set, named_sets, ["_set"], copies.select("_set", "_rows"))
    columns = [*unpacked(kept), F.col("n_shingles"), F.col("component_id")]
    columns += [F.col("_component").alias(label)] if label else []
    return full.select(*columns).union(empty.select(*columns))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, part: int = PART) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id (then text hash); rows without a set stay."""
    body = F.col(f"`{text}`")
    marked = docs.select(
        packed(docs.columns),
        body.alias("text"),
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("~")).alias("_key"),
        F.coalesce(F.xxhash64(body), F.lit(0).cast("long")).alias("_hash"),
    )
    spark = docs.sparkSession
    losers_at, repeated_at = new_folder(spark, "losers"), new_folder(spark, "repeated")
    with temporary_folders(spark):  # of all the join's tables only the ids of what goes are kept
        found = stored(join_components(marked, "text", "doc_id", ["doc_id", "_key", "_hash"], "_label", size, part).where("_label is not null"), "grouped")
        best = found.groupBy("_label").agg(F.min(F.struct("doc_id", "_key", "_hash")).alias("_best"), F.count(F.lit(1)).alias("_rows"))
        several = stored(best.where("_rows > 1"), "several")
        members = hot_join(found, several.select("_label", "_best"), ["_label"], several.select("_label", "_rows"))
        loser = (F.col("_key") != F.col("_best._key")) | (F.col("_hash") != F.col("_best._hash"))
        members.where(loser).select("_key", "_hash").distinct().write.parquet(losers_at)
        losers = spark.read.schema("_key string, _hash bigint").parquet(losers_at)
        # Repeated rows of a winner: same id and text.
        repeated = found.groupBy("_key", "_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key", "_hash")
        repeated.join(losers, ["_key", "_hash"], "left_anti").write.parquet(repeated_at)
        repeated = spark.read.schema("_key string, _hash bigint").parquet(repeated_at)
    kept = lookup_join(marked, losers, ["_key", "_hash"], "left_anti")
    if not repeated.isEmpty():
        single = lookup_join(kept, repeated, ["_key", "_hash"], "left_anti")
        again = lookup_join(kept, repeated, ["_key", "_hash"], "left_semi").dropDuplicates(["_key", "_hash"])
        kept = single.unionByName(again)
    return kept.select(*unpacked(docs.columns))
