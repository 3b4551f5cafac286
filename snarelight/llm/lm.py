"""Language-model scores from a probabilistic suffix tree over words.

Symbols are words (A-Z lowered) and one end per text; a text's symbols have an end before the first.
A context is what stands before a symbol, one to ``depth`` symbols of the same text. All floors are
evidence, not shares, so the tree grows with the corpus: a context is a candidate once seen
``least_context`` times, a successor is listed in it once seen there ``least_next`` times. A context
is retained if its next-symbol distribution diverges from its parent suffix's by at least
``MIN_BITS`` bits a symbol and ``MIN_GAIN`` bits in all. Distributions are smoothed by absolute
discounting: what is taken from listed successors goes to the others in proportion to the parent's
distribution; the root is the unigram distribution with 0.1 added to each count. A text's score is
the log10 probability of its symbols, each under the longest retained suffix before it.

On Spark: texts are stored once as lists of word digests; strings of symbols are 64-bit digests, too. Each
level is counted in a pass over those lists that leaves out strings whose two shorter halves miss their floors
(bitmaps of fixed size say so; what they let through too much is cut by its exact count). Tasks count a million
strings at a time and deal them to buckets by context (those of hot contexts by the last symbol), one packed row a
bucket; a group is a bucket, their number grows with the corpus. Contexts, divergences
and probabilities are tables made by grouping and joins. The probability of a symbol is its root's times one
factor for each string that ends there or just before, so a text's score is its base score plus a sum over its
strings: strings with a share of at least 2^-HOT_BITS at their level (a bounded number) are broadcast, the others
are dealt to buckets, too, and meet their factors there, together with the words below a share of 2^-HEAD_BITS,
which meet their counts; one pass over the texts does both.
Tables that nothing reads again are removed while the result is built; the result itself is a join of two.

A text is trained on unless crc32 of its id (as text, null: empty) is a multiple of 10. Null and empty
texts are one end. Repeated rows count and are scored each; there are no ties to break. Long texts
are numbered whole, at a few hundred bytes a word. Empty tables give empty results; without training
texts every word is unknown. Input columns with the name of a result are replaced, others never clash.
Two words or strings with one digest (of 64 bits) would be taken for the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snarelight.llm import common
from snarelight.llm.common import arrow_slices, hot_join, packed, split_words, stored, unpacked, without
from snarelight.session import discard, settings

HEAD_BITS, HOT_BITS = 20, 20
DEPTH, LEAST_NEXT, LEAST_CONTEXT = 3, 4, 64
MIN_BITS, MIN_GAIN, DISCOUNT = 0.02, 10.0, 0.5
ADDED = 0.1
#: Words of a slice, keys counted at a time in a task, texts it takes in at a time, bytes of a file's different digests.
SLICE_WORDS, FLUSH_KEYS, BATCH_TEXTS, DICTIONARY_BYTES = 1 << 18, 1 << 20, 1000, 16 << 20
#: Bits that a digest has in a bitmap.
BITS_EACH = 2
#: Parts of a bitmap, and buckets of the different words for each shuffle partition.
PIECES, WORD_BUCKETS = 16, 4
#: A block has 2^TEXT_BITS texts.
TEXT_BITS = 12
#: Symbols of the corpus for each bucket of counted strings, and of rare words and strings.
COUNTED_KEYS, RARE_KEYS = 1 << 20, 1 << 22
#: Parts of the rare words' and strings' buckets that are shuffled one after the other.
ROUNDS = 4
#: Bytes that a file of packed rows holds back in memory.
ROW_GROUP_BYTES = 16 << 20
END = b""
SEED = 42
RESULTS = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def key_filter(keys: DataFrame, column: str) -> bytes:
    """As ``common.key_filter``; a task sends its bits packed, a million keys at a time."""
    total = common.FILTER_BITS
    piece = max(64, total // PIECES)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _filled(batch.column(0).to_numpy() for batch in batches):
            bit = np.unique(np.concatenate([np.mod(part >> (32 * k), total) for k in range(BITS_EACH)]))
            rows = [(int(bit[a]) // piece, b - a, _steps(bit[a:b])) for a, b in _cuts(bit // piece)]
            yield _record(rows, {"piece": pa.int32(), "size": pa.int32(), "bits": pa.binary()})

    def merged(rows: pa.Table) -> pa.Table:
        held = np.zeros(piece, bool)
        for r in _rows(rows):
            held[_unstepped(r["bits"], r["size"]) % piece] = True
        return pa.table({"piece": rows.column("piece").slice(0, 1), "bits": [np.packbits(held, bitorder="little").tobytes()]})

    dealt = keys.select(F.col(column)).mapInArrow(bits, "piece int, size int, bits binary").groupBy("piece")
    # Stored first: a table's shuffle files go with its writing, those of a collected result stay for long.
    found = stored(dealt.applyInArrow(merged, "piece int, bits binary"), "bits")
    out = bytearray(total // 8)
    for r in found.toArrow().to_pylist():
        out[r["piece"] * (piece // 8) : (r["piece"] + 1) * (piece // 8)] = r["bits"]
    discard(found)
    return bytes(out)


def may_hold(bitmap: bytes, keys: np.ndarray) -> np.ndarray:
    return common.may_hold(bitmap, keys, BITS_EACH)


def _held_out(doc_id: str):
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _digests(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64).view(np.int64)


END_DIGEST = _digests([END])[0]


def _coded(docs: DataFrame, text: str, doc_id: str, keep: list[str]) -> DataFrame:
    """_row, _user (the columns ``keep``), held_out and _words: the digests of a text's lowered words (bytes: A-Z, six white spaces)."""
    rows = docs.select(
        packed(keep), _held_out(doc_id).alias("held_out"), F.col(f"`{text}`").alias("_text"), F.array().cast("array<bigint>").alias("_words")
    )
    text_at, words_at = rows.columns.index("_text"), rows.columns.index("_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, text_at):
            words, sizes = split_words(pc.ascii_lower(batch.column(text_at).cast(pa.large_string())))
            coded = words.dictionary_encode()
            digests = _digests(coded.dictionary.cast(pa.large_binary()).to_pylist())
            columns = list(batch.columns)
            columns[text_at] = pa.nulls(batch.num_rows, pa.string())
            columns[words_at] = _lists(pa.array(digests[coded.indices.to_numpy(zero_copy_only=False)], pa.int64()), sizes)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema).drop("_text").withColumn("_row", F.monotonically_increasing_id())


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _store_coded(coded: DataFrame) -> DataFrame:
    # A file's digests repeat: with room for its different ones, a dictionary takes two bytes a word instead of eight.
    return stored(coded, "coded", **{"parquet.dictionary.page.size": str(DICTIONARY_BYTES), "compression": "zstd"})


def unigrams(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """key (digest of a word or of the end) and c, over the training texts."""
    return _unigrams(_coded(docs, text, doc_id, []).where(~F.col("held_out")).select("_words"))


def _unigrams(train: DataFrame) -> DataFrame:
    buckets = _buckets(WORD_BUCKETS * int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _filled(symbols.digest[symbols.from_place(1)] for _, symbols in symbol_slices(batches, 0)):
            keys, n = np.unique(part.view(np.uint64), return_counts=True)
            bucket = _bucket(keys, buckets)
            rows = [(int(bucket[a]), b - a, _steps(keys[a:b]), _pressed(n[a:b].astype(np.uint32))) for a, b in _cuts(bucket)]
            yield _record(rows, {"bucket": pa.int32(), "size": pa.int32(), "keys": pa.binary(), "n": pa.binary()})

    def counted(rows: pa.Table) -> pa.Table:
        parts = [(_unstepped(r["keys"], r["size"]), _unpressed(r["n"], r["size"], np.uint32)) for r in _rows(rows)]
        keys, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(keys)
        starts = _changes(keys[order])
        return pa.table({"key": keys[order[starts]], "c": np.add.reduceat(n[order], starts, dtype=np.int64)})

    return train.mapInArrow(tallied, "bucket int, size int, keys binary, n binary").groupBy("bucket").applyInArrow(counted, "key bigint, c bigint")


def _filled(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The numbers of all parts, about FLUSH_KEYS at a time."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= FLUSH_KEYS:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def _record(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=list(kinds))


def _rows(table: pa.Table) -> Iterator[dict]:
    for batch in table.to_batches():
        yield from batch.to_pylist()


def _buckets(total: int, size: int) -> int:
    return min(max(1, -(-total // size)), 1 << 20)


def _bucket(digests: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the digests, in their order as unsigned numbers."""
    return (digests.view(np.uint64) >> np.uint64(44)) * np.uint64(buckets) >> np.uint64(20)


def _bucket_column(name: str, buckets: int):
    return F.shiftright(F.shiftrightunsigned(name, 44) * buckets, 20).cast("int")


def _cuts(bucket: np.ndarray) -> list[tuple[int, int]]:
    """Where each bucket starts and ends in sorted ones."""
    at = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    return list(zip(at[:-1], at[1:], strict=True))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _pressed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values), codec="zstd", asbytes=True)


def _pressed_bitmaps(bitmaps: list[bytes]) -> list[tuple[bytes, int]]:
    """Every executor keeps a file of what is broadcast."""
    return [(pa.compress(b, codec="zstd", asbytes=True), len(b)) for b in bitmaps]


def _bitmaps(pressed: list[tuple[bytes, int]]) -> list[bytes]:
    return [pa.decompress(b, n, codec="zstd", asbytes=True) for b, n in pressed]


def _unpressed(blob: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, codec="zstd") if n else b"", kind)


def _planes(values: np.ndarray) -> bytes:
    """Numbers of 8 bytes whose upper ones seldom change."""
    return _pressed(values.view(np.uint8).reshape(-1, 8).T)


def _unplaned(blob: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(_unpressed(blob, n * 8, np.uint8).reshape(8, n).T).view(np.int64).ravel()


def _word_blob(words: np.ndarray, rank: np.ndarray) -> bytes:
    """Digests as ranks from 1 in the broadcast words, and those of rank 0 at length."""
    ranks = _pressed(rank.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return len(ranks).to_bytes(4, "little") + ranks + _pressed(words[rank == 0])


def _word_array(blob: bytes, n: int, ranked: np.ndarray) -> np.ndarray:
    end = 4 + int.from_bytes(blob[:4], "little")
    rank = np.ascontiguousarray(_unpressed(blob[4:end], n * 4, np.uint8).reshape(4, n).T).view(np.uint32).ravel()
    out, known = np.empty(n, np.int64), rank > 0
    out[known] = ranked[rank[known] - 1]
    out[~known] = _unpressed(blob[end:], n - int(known.sum()), np.int64)
    return out


def _steps(values: np.ndarray) -> bytes:
    """Sorted numbers of 8 bytes."""
    return _planes(np.diff(values.view(np.int64), prepend=np.int64(0)))


def _unstepped(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unplaned(blob, n))


@dataclass
class Head:
    """Frequent words (digests) with their counts, the most frequent first."""

    words: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    least: int

    def __post_init__(self) -> None:
        self.log_norm = float(np.log10(self.total + ADDED * (self.distinct + 1)))

    def root(self) -> np.ndarray:
        return np.log10(self.counts + ADDED) - self.log_norm


def head_of(counts: DataFrame) -> Head:
    """Collects at most 2^HEAD_BITS words: each has that share of all tokens."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    least = max(2, total >> HEAD_BITS)
    rows = counts.where(F.col("c") >= least).toArrow().sort_by([("c", "descending"), ("key", "ascending")])
    return Head(rows.column("key").to_numpy().astype(np.int64), rows.column("c").to_numpy().astype(np.int64), total, distinct, least)


class Symbols:
    """The symbols of some texts (lists of word digests) in a row, each text's with an end before and after."""

    def __init__(self, texts: pa.ListArray) -> None:
        self.n_words = texts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = self.n_words + 2
        self.starts = np.cumsum(lengths) - lengths
        #: The text of each symbol, and its digest.
        self.text = np.repeat(np.arange(len(lengths)), lengths)
        self.digest = np.full(len(self.text), END_DIGEST)
        inner = np.ones(len(self.text), bool)
        inner[self.starts] = inner[self.starts + lengths - 1] = False
        self.digest[inner] = texts.flatten().to_numpy(zero_copy_only=False)
        self.last = self.starts + lengths - 1

    def from_place(self, place: int) -> np.ndarray:
        """Which symbols have at least ``place`` others before them in their text."""
        out = np.ones(len(self.text), bool)
        # A text has two symbols at least, so the third place may be the next text's first; there is no need to look further.
        for k in range(place):
            at = self.starts + k
            out[at[at <= self.last]] = False
        return out

    def strings(self, depth: int) -> Iterator[np.ndarray]:
        """Digests of the strings of 1, 2 .. depth + 1 symbols that end at each symbol (if as many stand in its text)."""
        symbol = self.digest.view(np.uint64)
        ending = symbol
        yield ending.view(np.int64)
        for _ in range(depth):
            ending = np.concatenate([ending[:1], _joined(ending[:-1], symbol[1:])])
            yield ending.view(np.int64)


def symbol_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Symbols]]:
    """The batches cut so that each has about SLICE_WORDS words, with their symbols."""
    for batch in batches:
        sizes = batch.column(column).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        piece = np.cumsum(sizes) // SLICE_WORDS
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(sizes)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if end > start:
                cut = batch.slice(start, end - start)
                yield cut, Symbols(cut.column(column))


def _joined(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The digest of a string from that of all but its last symbol and the last symbol's (a 64-bit finaliser)."""
    x = context * np.uint64(0x9E3779B97F4A7C15) ^ symbol
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _by_context(bucket: np.ndarray, ctx: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """An order by bucket that brings nearly all equal contexts together, and equal symbols in them (some bits are enough)."""
    some = np.uint64((1 << 22) - 1)
    return np.argsort(bucket << np.uint64(44) | (ctx.view(np.uint64) & some) << np.uint64(22) | (symbol.view(np.uint64) & some))


#: Strings of a bucket: their last symbols and counts, and for each stretch of one context its length, digest and digest without the first symbol.
COUNTED = "bucket int, size int, runs int, symbol binary, n binary, length binary, ctx binary, short binary"


def _counted_strings(
    train: DataFrame, level: int, bitmaps: list[bytes], hot: np.ndarray, ranked: Broadcast, buckets: int, least_next: int
) -> DataFrame:
    """key, ctx (all but the last symbol), low (all but the first) and n of the strings of level + 1 symbols that occur
    ``least_next`` times and whose first and last ``level`` symbols may be in the bitmaps."""
    sent = train.sparkSession.sparkContext.broadcast((_pressed_bitmaps(bitmaps), np.sort(hot)))

    def flushed(held: list[tuple[np.ndarray, ...]], known: pd.Index) -> pa.RecordBatch:
        ctx, short, symbol = (np.concatenate(c) for c in zip(*held, strict=True))
        spread = sent.value[1]
        if len(spread):
            near = spread[np.minimum(np.searchsorted(spread, ctx), len(spread) - 1)]
            bucket = _bucket(np.where(near == ctx, symbol, ctx), buckets)
        else:
            bucket = _bucket(ctx, buckets)
        order = _by_context(bucket, ctx, symbol)
        ctx, short, symbol, bucket = ctx[order], short[order], symbol[order], bucket[order]
        first = _changes(ctx, symbol)
        n = np.diff(np.append(first, len(ctx))).astype(np.uint32)
        ctx, short, symbol, bucket = ctx[first], short[first], symbol[first], bucket[first]
        runs = _changes(ctx, bucket)
        length = np.diff(np.append(runs, len(ctx))).astype(np.uint32)
        ctx, short, rows = ctx[runs], short[runs], []
        ranks = [known.get_indexer(c) + 1 for c in (symbol, ctx, short)]
        for start, end in _cuts(bucket):
            a, b = np.searchsorted(runs, [start, end]).tolist()
            heads = [_word_blob(c[a:b], rank[a:b]) for c, rank in zip((ctx, short), ranks[1:], strict=True)]
            blobs = [_word_blob(symbol[start:end], ranks[0][start:end]), _pressed(n[start:end]), _pressed(length[a:b])]
            rows.append((int(bucket[start]), end - start, b - a, *blobs, *heads))
        names = [c.split()[0] for c in COUNTED.split(", ")]
        return _record(rows, dict(zip(names, [pa.int32()] * 3 + [pa.binary()] * 5, strict=True)))

    def packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, known = [], 0, pd.Index(ranked.value)
        contexts, listed = _bitmaps(sent.value[0])
        for _, symbols in symbol_slices(batches, 0):
            *_, below, _ = strings = list(symbols.strings(level))
            at = np.flatnonzero(symbols.from_place(level))
            at = at[may_hold(listed, below[at])]
            at = at[may_hold(contexts, below[at - 1])]
            if len(at):
                short = strings[level - 2][at - 1] if level > 1 else np.zeros(len(at), np.int64)
                held.append((below[at - 1], short, symbols.digest[at]))
                size += len(at)
            if size >= FLUSH_KEYS:
                yield flushed(held, known)
                held, size = [], 0
        if size:
            yield flushed(held, known)

    def counted(rows: pa.Table) -> pa.Table:
        parts = []
        for r in _rows(rows):
            length = _unpressed(r["length"], r["runs"], np.uint32)
            heads = [np.repeat(_word_array(r[c], r["runs"], ranked.value), length) for c in ("ctx", "short")]
            parts.append((*heads, _word_array(r["symbol"], r["size"], ranked.value), _unpressed(r["n"], r["size"], np.uint32)))
        ctx, short, symbol, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        key = _joined(ctx.view(np.uint64), symbol.view(np.uint64)).view(np.int64)
        order = np.argsort(key)
        starts = _changes(key[order])
        sums = np.add.reduceat(n[order], starts, dtype=np.int64)
        enough = sums >= least_next
        first = order[starts[enough]]
        low = _joined(short[first].view(np.uint64), symbol[first].view(np.uint64)).view(np.int64) if level > 1 else symbol[first]
        return pa.table({"key": key[first], "ctx": ctx[first], "low": low, "n": sums[enough]})

    dealt = train.mapInArrow(packed_rows, COUNTED)
    return dealt.groupBy("bucket").applyInArrow(counted, "key bigint, ctx bigint, low bigint, n bigint")


def _level(found: DataFrame, below: DataFrame, least_next: int, least_context: int) -> tuple[DataFrame, DataFrame]:
    """The retained contexts (ctx, total, other) and all strings (key, n, logp, factor) of a level; removes ``found``.

    ``other`` is the factor (log10) of a symbol not listed in the context, ``logp`` the probability of the
    last symbol under the longest retained context up to this level, ``factor`` what a listed one gets beside ``other``.
    """
    parents = below.select(F.col("key").alias("low"), F.col("logp").alias("parent"))
    # A string or context that occurs n times has at most this many listed ones.
    most = lambda name: below.select(F.col("key").alias(name), F.floor(F.col("n") / least_next).alias("_rows"))
    keys = stored(hot_join(found, parents, ["low"], most("low")).drop("low"), "strings")
    discard(found)
    left = F.col("n") - DISCOUNT
    # The context's total is left out of the sums and comes in afterwards, one row a context.
    sums = keys.groupBy("ctx").agg(
        F.sum(left).alias("s"),
        F.sum(left * (F.log2(left) - F.col("parent") / F.lit(float(np.log10(2))))).alias("g"),
        F.sum(F.pow(F.lit(10.0), "parent")).alias("q"),
    )
    totals = below.where(F.col("n") >= least_context).select(F.col("key").alias("ctx"), F.col("n").cast("double").alias("total"))
    rest, parent_rest = F.greatest(1 - F.col("s") / F.col("total"), F.lit(1e-12)), F.greatest(1 - F.col("q"), F.lit(1e-12))
    bits = (F.col("g") - F.col("s") * F.log2("total")) / F.col("total") + rest * F.log2(rest / parent_rest)
    measured = sums.join(totals, "ctx").select("ctx", "total", F.log10(rest / parent_rest).alias("other"), bits.alias("bits"))
    enough = (F.col("bits") >= MIN_BITS) & (F.col("bits") * F.col("total") >= MIN_GAIN)
    retained = stored(measured.where(enough).drop("bits"), "contexts")
    joined = hot_join(keys, retained, ["ctx"], most("ctx"), "left")
    own = F.log10(left / F.col("total"))
    strings = joined.select(
        "key", "n", F.coalesce(own, F.col("parent")).alias("logp"), (own - F.col("parent") - F.col("other")).alias("factor")
    )
    out = stored(strings, "level")
    discard(keys)
    return retained, out


def tree(
    docs: DataFrame, counts: DataFrame, log_norm: float, text: str, doc_id: str,
    depth: int = DEPTH, least_next: int = LEAST_NEXT, least_context: int = LEAST_CONTEXT,
) -> tuple[DataFrame, list[DataFrame]]:
    """(id, n, factor) of all strings that change a probability, and the retained contexts by length."""
    coded = _store_coded(_coded(docs, text, doc_id, []))
    train = coded.where(~F.col("held_out")).select("_words")
    out = _tree(train, counts, head_of(counts), log_norm, depth, least_next, least_context)
    discard(coded)
    return out


def _tree(
    train: DataFrame, counts: DataFrame, head: Head, log_norm: float, depth: int, least_next: int, least_context: int
) -> tuple[DataFrame, list[DataFrame]]:
    root = F.log10(F.col("c") + F.lit(ADDED)) - F.lit(log_norm)
    below = stored(counts.select("key", F.col("c").alias("n"), root.alias("logp")), "words")
    levels, last, buckets = [], below, _buckets(head.total, COUNTED_KEYS)
    ranked = train.sparkSession.sparkContext.broadcast(head.words)
    for level in range(1, depth + 1):
        contexts = key_filter(last.where(F.col("n") >= least_context), "key")
        # Counted strings have a successor's evidence already.
        listed = key_filter(last if levels else last.where(F.col("n") >= least_next), "key")
        # Contexts with a quarter of a bucket are at most four times as many as the buckets.
        hot = last.where(F.col("n") >= max(least_context, COUNTED_KEYS // 4)).select("key").toArrow().column("key").to_numpy().astype(np.int64)
        last = stored(_counted_strings(train, level, [contexts, listed], hot, ranked, buckets, least_next), f"counted{level}")
        levels.append(last)
    parts, contexts, done = [], [], []
    for level, strings in enumerate(levels, start=1):
        retained, own = _level(strings, below, least_next, least_context)
        if level == 1:
            discard(below)
        below = own
        contexts.append(retained)
        done.append(below)
        parts.append(retained.select(F.col("ctx").alias("id"), F.col("total").cast("long").alias("n"), F.col("other").alias("factor")))
        parts.append(below.where(F.col("factor").isNotNull()).select(F.col("key").alias("id"), "n", "factor"))
    none = counts.where(F.lit(False)).select(F.lit(0).cast("long").alias("id"), F.col("c").alias("n"), F.lit(0.0).alias("factor"))
    both = reduce(DataFrame.unionByName, parts, none)
    factors = stored(both.groupBy("id").agg(F.max("n").alias("n"), F.sum("factor").alias("factor")), "factors")
    discard(*(done or [below]))
    return factors, contexts


class Candidates:
    """The strings of some texts that may have a factor, by bitmaps of the retained contexts and of all strings with one."""

    def __init__(self, contexts: bytes, factors: bytes, depth: int) -> None:
        self.contexts, self.factors, self.depth = contexts, factors, depth

    def of(self, symbols: Symbols) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Where they end, and their ids; length by length."""
        inside = None
        for level, own in enumerate(symbols.strings(self.depth)):
            there = symbols.from_place(level)
            # Nothing follows the last end: it is no context.
            there[symbols.last] &= level > 0
            context = may_hold(self.contexts, own)
            # A string with a factor is a context, or listed in one.
            at = np.flatnonzero(there & (context if inside is None else context | np.concatenate([[False], inside[:-1]])))
            at = at[may_hold(self.factors, own[at])]
            yield at, own[at]
            inside = context


def score(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None,
    depth: int = DEPTH, least_next: int = LEAST_NEXT, least_context: int = LEAST_CONTEXT,
) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all but the text) with RESULTS."""
    # Ten thousand texts' digests at once (Spark's default) are tens of MB in each of JVM and Python.
    with settings(docs.sparkSession, spark_sql_execution_arrow_maxRecordsPerBatch=str(BATCH_TEXTS)):
        return _score(docs, text, doc_id, keep, depth, least_next, least_context)


def _score(
    docs: DataFrame, text: str, doc_id: str, keep: list[str] | None, depth: int, least_next: int, least_context: int
) -> DataFrame:
    context = docs.sparkSession.sparkContext
    kept = [c for c in without(docs, RESULTS).columns if c != text] if keep is None else keep
    coded = _store_coded(_coded(docs, text, doc_id, kept))
    train = coded.where(~F.col("held_out")).select("_words")
    counts = stored(_unigrams(train), "unigrams")
    head = head_of(counts)
    factors, contexts = _tree(train, counts, head, head.log_norm, depth, least_next, least_context)
    # Strings of one length occur about as often as there are tokens, so at most 2^HOT_BITS of them have this share.
    least = max(2, head.total >> HOT_BITS)
    hot = factors.where(F.col("n") >= least).select("id", "factor").toArrow()
    ids, values = hot.column("id").to_numpy().astype(np.int64), hot.column("factor").to_numpy().astype(float)
    retained = reduce(DataFrame.unionByName, [c.select("ctx") for c in contexts], counts.where(F.lit(False)).select(F.col("key").alias("ctx")))
    bitmaps = [key_filter(retained, "ctx"), key_filter(factors, "id"), key_filter(counts.where(F.col("c") < head.least), "key")]
    # A rare word's entry has the inverse of its digest: the digest itself is that of a context.
    root = F.log10(F.col("c") + F.lit(ADDED)) - F.lit(head.log_norm)
    tail = counts.where(F.col("c") < head.least).select(F.bitwise_not("key").alias("id"), root.alias("base"), root.alias("factor"))
    rare = tail.unionByName(factors.where(F.col("n") < least).select("id", F.lit(None).cast("double").alias("base"), "factor"))
    # Broadcasts hold plain data: workers need no copy of this package.
    ranked = context.broadcast(head.words)
    sent = context.broadcast((head.root(), ids, values, _pressed_bitmaps(bitmaps)))
    buckets = _buckets(head.total, RARE_KEYS)
    rows = coded.select(
        "_row",
        "_user",
        "held_out",
        F.lit(0).cast("long").alias("n_tokens"),
        F.lit(0).cast("long").alias("_n_head"),
        F.lit(0.0).alias("_base"),
        F.lit(0.0).alias("_score"),
        "_words",
    )
    row_at, words_at = rows.columns.index("_row"), rows.columns.index("_words")
    own_rows = [f for f in rows.schema.fields if f.name != "_words"]
    numbers, blobs = ["bucket", "size", "runs"], ["texts", "ids", "symbol", "ctx", "length"]
    kinds = {n: pa.int32() for n in numbers} | {n: pa.binary() for n in blobs}
    packed_fields = [T.StructField(n, T.IntegerType()) for n in numbers] + [T.StructField(n, T.BinaryType()) for n in blobs]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in own_rows] + packed_fields)

    def flushed(held: list[tuple[np.ndarray, ...]]) -> dict[str, pa.Array]:
        """Ids and texts of rare words and strings, one packed row a bucket."""
        own, text = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(own.view(np.uint64))
        own, text = own[order], text[order]
        bucket = _bucket(own, buckets)
        made = [(int(bucket[a]), b - a, None, _planes(text[a:b]), _steps(own[a:b]), None, None, None) for a, b in _cuts(bucket)]
        return dict(zip(kinds, _record(made, kinds).columns, strict=True))

    def flushed_pairs(held: list[tuple[np.ndarray, ...]], known: pd.Index) -> dict[str, pa.Array]:
        """The same of strings of two symbols, as stretches of one first symbol."""
        ctx, symbol, text = (np.concatenate(c) for c in zip(*held, strict=True))
        bucket = _bucket(_joined(ctx.view(np.uint64), symbol.view(np.uint64)), buckets)
        order = _by_context(bucket, ctx, symbol)
        ctx, symbol, text, bucket = ctx[order], symbol[order], text[order], bucket[order]
        runs = _changes(ctx, bucket)
        length, ctx, made = np.diff(np.append(runs, len(ctx))).astype(np.uint32), ctx[runs], []
        symbol_rank, ctx_rank = known.get_indexer(symbol) + 1, known.get_indexer(ctx) + 1
        for start, end in _cuts(bucket):
            a, b = np.searchsorted(runs, [start, end]).tolist()
            words = _word_blob(symbol[start:end], symbol_rank[start:end]), _word_blob(ctx[a:b], ctx_rank[a:b])
            made.append((int(bucket[start]), end - start, b - a, _planes(text[start:end]), None, *words, _pressed(length[a:b])))
        return dict(zip(kinds, _record(made, kinds).columns, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums over frequent words and strings of each text, and the rare ones in rows of their own."""
        root, ids, values, pressed = sent.value
        of_contexts, of_factors, tail_bits = _bitmaps(pressed)
        candidates, known, hot = Candidates(of_contexts, of_factors, depth), pd.Index(ranked.value), pd.Index(ids)
        held, size, pairs, n_pairs, kind_of = [], 0, [], 0, dict(kinds)

        def of(made: dict[str, pa.Array]) -> pa.RecordBatch:
            n = len(next(iter(made.values())))
            return pa.RecordBatch.from_arrays([made.get(f, pa.nulls(n, kind_of[f])) for f in schema.names], names=schema.names)

        for batch, symbols in symbol_slices(batches, words_at):
            n, row = batch.num_rows, batch.column(row_at).to_numpy()
            kind_of |= {f.name: f.type for f in batch.schema}
            per_text = lambda at, weights=None: np.bincount(symbols.text[at], weights, n)
            at = np.flatnonzero(symbols.from_place(1))
            number = known.get_indexer(symbols.digest[at])
            rare_at, at, number = at[number < 0], at[number >= 0], number[number >= 0]
            rare_at = rare_at[may_hold(tail_bits, symbols.digest[rare_at])]
            held.append((~symbols.digest[rare_at], row[symbols.text[rare_at]]))
            base = per_text(at, root[number]).astype(float)  # without symbols the counts are whole numbers
            made = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            made |= {"n_tokens": pa.array(symbols.n_words + 1), "_n_head": pa.array(per_text(at).astype(np.int64)), "_base": pa.array(base)}
            logs = base.copy()
            for level, (at, own) in enumerate(candidates.of(symbols)):
                place = hot.get_indexer(own)
                logs += per_text(at[place >= 0], values[place[place >= 0]])
                at, own = at[place < 0], own[place < 0]
                if level == 1:
                    pairs.append((symbols.digest[at - 1], symbols.digest[at], row[symbols.text[at]]))
                    n_pairs += len(at)
                else:
                    held.append((own, row[symbols.text[at]]))
                    size += len(at)
            size += len(rare_at)
            yield of(made | {"_score": pa.array(logs)})
            if size >= FLUSH_KEYS:
                yield of(flushed(held))
                held, size = [], 0
            if n_pairs >= FLUSH_KEYS:
                yield of(flushed_pairs(pairs, known))
                pairs, n_pairs = [], 0
        if size:
            yield of(flushed(held))
        if n_pairs:
            yield of(flushed_pairs(pairs, known))

    def met(strings: pa.Table, own: pa.Table) -> pa.Table:
        """What the rare words and strings of a bucket add to their texts."""
        ids = own.column("id").to_numpy()
        order = np.argsort(ids)
        ids, factor, base = ids[order], own.column("factor").to_numpy()[order], own.column("base").to_numpy()[order].astype(float)
        is_word, base = ~np.isnan(base), np.nan_to_num(base)
        done, held, size = [], [], 0

        def summed() -> None:
            row, place = (np.concatenate(c) for c in zip(*held, strict=True))
            texts, text = np.unique(row, return_inverse=True)
            known = np.bincount(text, is_word[place]).astype(np.int64)
            sums = np.bincount(text, base[place]), np.bincount(text, factor[place])
            for a, b in _cuts(texts >> TEXT_BITS):
                done.append((int(texts[a]) >> TEXT_BITS, b - a, _steps(texts[a:b]), _planes(known[a:b]), *[_pressed(c[a:b]) for c in sums]))

        for r in _rows(strings) if len(ids) else []:
            row = _unplaned(r["texts"], r["size"])
            if r["ids"] is None:
                ctx = np.repeat(_word_array(r["ctx"], r["runs"], ranked.value), _unpressed(r["length"], r["runs"], np.uint32))
                key = _joined(ctx.view(np.uint64), _word_array(r["symbol"], r["size"], ranked.value).view(np.uint64)).view(np.int64)
            else:
                key = _unstepped(r["ids"], r["size"])
            place = np.minimum(np.searchsorted(ids, key), len(ids) - 1)
            at = np.flatnonzero(ids[place] == key)
            held.append((row[at], place[at]))
            size += len(at)
            if size >= FLUSH_KEYS:
                summed()
                held, size = [], 0
        if size:
            summed()
        types = [pa.int64(), pa.int32()] + [pa.binary()] * 4
        columns = list(zip(*done, strict=True)) or [[]] * len(types)
        return pa.table([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=["block", "size", "texts", "known", "base", "factor"])

    def added(rows: pa.Table) -> pa.Table:
        """The sums of a block of texts over the buckets."""
        parts = []
        for r in _rows(rows):
            numbers = [_unpressed(r[c], r["size"], np.float64) for c in ("base", "factor")]
            parts.append((_unstepped(r["texts"], r["size"]), _unplaned(r["known"], r["size"]), *numbers))
        row, known, base, factor = (np.concatenate(c) for c in zip(*parts, strict=True))
        texts, text = np.unique(row, return_inverse=True)
        sums = [np.bincount(text, base), np.bincount(text, known).astype(np.int64), np.bincount(text, factor)]
        return pa.table([texts, *sums], names=["_row", "_rare_base", "_rare_known", "_rare_score"])

    both = stored(rows.mapInArrow(run, schema), "scored", **{"parquet.block.size": str(ROW_GROUP_BYTES)})
    discard(coded, *contexts)
    entries = rare.select(_bucket_column("id", buckets).alias("bucket"), "id", "base", "factor")
    rounds, found = min(ROUNDS, buckets), []
    for k in range(rounds):
        # A part of the buckets at a time: only its shuffle files are there beside the stored rows.
        dealt, own = (df.where(F.col("bucket") % rounds == k).groupBy("bucket") for df in (both.select(*kinds), entries))
        part = dealt.cogroup(own).applyInArrow(met, "block bigint, size int, texts binary, known binary, base binary, factor binary")
        found.append(stored(part, "found"))
    scored = stored(both.where(F.col("bucket").isNull()).drop(*kinds), "texts")
    discard(both, counts, factors)
    sent.destroy()
    blocks = reduce(DataFrame.unionByName, found).groupBy("block")
    sums = stored(blocks.applyInArrow(added, "_row bigint, _rare_base double, _rare_known bigint, _rare_score double"), "rare")
    discard(*found)
    parts = scored.join(sums, "_row", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    n_known = F.col("_n_head") + F.coalesce(F.col("_rare_known"), F.lit(0))
    others = zero("_rare_base") + (F.col("n_tokens") - n_known) * F.lit(float(np.log10(ADDED)) - head.log_norm)
    return parts.select(
        *unpacked(kept),
        "held_out",
        "n_tokens",
        n_known.alias("n_known"),
        F.lit(head.total).cast("long").alias("train_tokens"),
        (F.col("_base") + others).alias("base_score"),
        (F.col("_score") + others + zero("_rare_score") - zero("_rare_base")).alias("score"),
    )
