"""Benchmark decontamination with suffix arrays over the training texts.

Every task makes word-level suffix arrays of shards of its documents (about ``SHARD_WORDS`` words
each) and binary-searches every test suffix in them. A test suffix is compared up to a window of
``window`` words; an item with fewer words is one window. Consecutive hits on one item's words join
to the longest verbatim matches, reported with their places in document and item. Documents with a
hit can then be removed.

The benchmark is a query set: it is read in blocks of bounded size, each block is broadcast and
searched in all documents, so documents are never shuffled and no block grows with the benchmark.

Words are runs of digits, letters and non-ASCII characters, A-Z lowered. Null and empty texts have
no words and no hits; items without words have no windows; items with a null id are named "null";
repeated rows are searched alike. Empty tables give empty results or no hits. Input columns with
the name of a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snarelight.llm.common import restored, shielded, slices, stored, without

WINDOW = 10
BLOCK_WORDS = 1_000_000
SHARD_WORDS = 2_000_000
#: So many blocks are searched in one job; after that the texts are written out with what was found.
BLOCKS_PER_PASS = 8
RESULTS = ["n_words", "n_hit", "item_ids", "matches"]

_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
#: Byte by byte: A-Z to a-z, what is in no word to a space.
_FOLD = bytes(b if b in _KEEP else 32 for b in bytes(range(256)).lower())
_MATCH = pa.struct(
    [("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Block:
    """Test suffixes of some items: distinct windows as rows of word numbers, and where they stand."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        # items: (id, words, number of the first word in the item)
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.ids = [name for name, _, _ in items]
        rows, lengths, places = [], [], []
        for k, (_, words, first) in enumerate(items):
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            size = min(window, len(numbers))
            for at in range(len(numbers) - size + 1 if size else 0):
                rows.append(numbers[at : at + size] + [0] * (window - size))
                lengths.append(size)
                places.append((k, first + at))
        table = np.array(rows, np.int32).reshape(len(rows), window)
        self.windows, which = np.unique(table, axis=0, return_inverse=True)
        self.lengths = (self.windows > 0).sum(1)
        by = np.argsort(which.ravel(), kind="stable")
        self.places = np.array(places, np.int64).reshape(len(places), 2)[by]
        counts = np.bincount(which.ravel(), minlength=len(self.windows))
        self.first_place = np.concatenate([[0], np.cumsum(counts)])
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0

    def found(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``numbers`` (words; 0 for words of no item and between texts) and windows found there."""
        nothing = np.zeros(0, np.int64)
        if not len(self.windows) or not len(numbers):
            return nothing, nothing
        # A suffix can only match if it starts with enough known words; others stay out of the array.
        ends = np.where(numbers == 0, np.arange(len(numbers)), len(numbers))
        run = np.minimum.accumulate(ends[::-1])[::-1] - np.arange(len(numbers))
        starts = np.flatnonzero(run >= self.shortest)
        if not len(starts):
            return nothing, nothing
        padded = np.concatenate([numbers, np.zeros(self.window, np.int32)])
        columns = [padded[starts + c] for c in range(self.window)]
        for c in range(1, self.window):  # nothing beyond the first unknown word
            columns[c] = np.where(run[starts] > c, columns[c], 0)
        order = np.lexsort(columns[::-1])
        array, columns = starts[order], [c[order] for c in columns]
        low = np.zeros(len(self.windows), np.int64)
        high = np.full(len(self.windows), len(array), np.int64)
        alive = np.arange(len(self.windows))
        for c in range(self.window):
            alive = alive[(low[alive] < high[alive]) & (self.lengths[alive] > c)]
            value = self.windows[alive, c]
            left = _bisect(columns[c], low[alive], high[alive], value)
            right = _bisect(columns[c], left, high[alive], value + 1)
            low[alive], high[alive] = left, right
        hit = np.flatnonzero(low < high)
        sizes = high[hit] - low[hit]
        steps = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return array[np.repeat(low[hit], sizes) + steps], np.repeat(hit, sizes)


def _bisect(column: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each query the first place in low..high whose entry is at least its value."""
    low, high = low.copy(), high.copy()
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) >> 1
        less = column[middle] < value[open_]
        low[open_] = np.where(less, middle + 1, low[open_])
        high[open_] = np.where(less, high[open_], middle)
    return low


def search_shard(texts: list[list[bytes]], block: Block) -> list[tuple[np.ndarray, list[dict]]]:
    """For each text of a shard: the words hit (places), and the longest matches."""
    known = block.vocabulary.get
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    numbers = np.zeros(starts[-1], np.int32)
    for s, t in zip(starts, texts, strict=False):
        numbers[s : s + len(t)] = [known(w, 0) for w in t]
    at, which = block.found(numbers)
    out: list = [(np.zeros(0, np.int64), []) for _ in texts]
    if not len(at):
        return out
    delta = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + block.lengths[which], -1)
    hit = np.flatnonzero(np.cumsum(delta[:-1]) > 0)
    n = (block.first_place[1:] - block.first_place[:-1])[which]
    steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item, word = block.places[np.repeat(block.first_place[:-1][which], n) + steps].T
    at, length = np.repeat(at, n), np.repeat(block.lengths[which], n)
    order = np.lexsort((at, at - word, item))
    at, item, word, length = at[order], item[order], word[order], length[order]
    new = np.ones(len(at), bool)
    new[1:] = (item[1:] != item[:-1]) | (at[1:] - word[1:] != at[:-1] - word[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    text_of = np.searchsorted(starts, at[first], side="right") - 1
    cuts = np.searchsorted(hit, starts)
    for k in range(len(texts)):
        if cuts[k] < cuts[k + 1]:
            out[k] = (hit[cuts[k] : cuts[k + 1]] - starts[k], [])
    for k, f, l in zip(text_of.tolist(), first.tolist(), last.tolist(), strict=True):
        out[k][1].append(
            {
                "item_id": block.ids[item[f]],
                "doc_word": int(at[f] - starts[k]),
                "item_word": int(word[f]),
                "n_words": int(at[l] - at[f] + length[l]),
            }
        )
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int) -> Iterator[list]:
    """The items in blocks of about BLOCK_WORDS words; long items in parts that overlap by a window."""
    block, held = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")), F.col(text).cast("binary"))
    for name, body in rows.toLocalIterator():
        words = words_of(None if body is None else bytes(body))
        for at in range(0, max(1, len(words) - window + 1), BLOCK_WORDS):
            part = words[at : at + BLOCK_WORDS + window - 1]
            block.append((name, part, at))
            held += len(part)
            if held >= BLOCK_WORDS:
                yield block
                block, held = [], 0
    if block:
        yield block


def search(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids (sorted, distinct) and matches (longest, with places)."""
    base = without(docs, RESULTS)
    df = shielded(base, text).withColumns({"n_words": F.lit(0).cast("long"), "_hit": F.array().cast("array<bigint>")})
    df = df.withColumn("matches", F.array().cast("array<struct<item_id:string,doc_word:bigint,item_word:bigint,n_words:bigint>>"))
    context = docs.sparkSession.sparkContext
    done = 0
    for block in _blocks(benchmark, item_id, item_text, window) or []:
        df = _pass(df, context.broadcast(block), window)
        done += 1
        if done % BLOCKS_PER_PASS == 0:
            df = stored(df, "searched")
    if not done:
        df = _pass(df, context.broadcast([]), window)
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return df.select(
        *restored(base.columns, text), "n_words", F.size("_hit").cast("long").alias("n_hit"), ids.alias("item_ids"), "matches"
    )


def _pass(df: DataFrame, items, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(items.value, window)
        for batch, texts in slices(batches, "text"):
            found, shard, held = [], [], 0
            words = [words_of(t) for t in texts]
            for w in words:
                shard.append(w)
                held += len(w)
                if held >= SHARD_WORDS:
                    found += search_shard(shard, block)
                    shard, held = [], 0
            found += search_shard(shard, block) if shard else []
            hits = [
                np.union1d(old, new).tolist() if old else new.tolist()
                for old, (new, _) in zip(batch.column("_hit").to_pylist(), found, strict=True)
            ]
            matches = [old + new for old, (_, new) in zip(batch.column("matches").to_pylist(), found, strict=True)]
            made = {
                "n_words": pa.array([len(w) for w in words], pa.int64()),
                "_hit": pa.array(hits, pa.list_(pa.int64())),
                "matches": pa.array(matches, pa.list_(_MATCH)),
            }
            yield pa.RecordBatch.from_arrays(
                [made.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)], names=batch.schema.names
            )

    return df.mapInArrow(run, df.schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns."""
    found = search(shielded(docs, text), benchmark, "text", **options)
    return found.where("n_hit = 0").select(*restored(docs.columns, text))
