"""Exact removal of long repeats by parsing at window minimizers and digests of the parts.

Rolling-hash triggers cut texts into phrases: a window of ``LENGTH`` bytes has its trigger at the
smallest rolling hash of ``GRAM`` bytes in it, the first of equals, so equal windows have their
trigger at the same place, and consecutive windows with one trigger form a phrase. A phrase's
windows are split by their distance to the trigger into parts of 128 distances. The windows of a
part share their core, the bytes that all of them cover.

* A part whose core occurs once in the corpus has no repeated window. That settles most text.
* Parts with equal bytes over their whole span (an entry of the dictionary that is parsed twice or
  more) are repeated as a whole.
* In the remaining groups of one core the suffixes differ somewhere: there the parts (dictionary
  suffix before the trigger, parse suffix after it) are split into narrower ones, one row per distinct
  part, down to single windows (``WIDTHS``), and judged in the same way.

Equality classes are all that removal needs: parts are grouped by digests, no suffix array of dictionary
or parse is built, and no suffix is sorted. Parts are equal if two 64-bit digests are, of the core and
of the whole span.

A null text counts as empty; texts shorter than a window are kept whole; repeated rows repeat each
other. Matches never cross documents. Very long texts are parsed in segments that overlap by a
window. Empty tables give empty results. Input columns with the name of a result are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snarelight.llm.common import hot_join, key_filter, may_hold, slices, stored, without

LENGTH, GRAM = 400, 16
#: Distances to the trigger in a part, level by level.
WIDTHS = (128, 16, 1)
PART = WIDTHS[0]
SEGMENT_BYTES = 512 << 10
RESULTS = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
_POSITION = np.uint64((1 << 24) - 1)
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any stretch of a buffer, from prefix sums modulo 2^64."""

    def __init__(self, length: int, which: int) -> None:
        odd = _ODD[which]
        self.letters = np.random.default_rng(which + 1).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = np.full(length + 1, odd, np.uint64)
        self.inverse = np.full(length + 1, pow(odd, -1, 1 << 64), np.uint64)
        self.power[0] = self.inverse[0] = 1
        np.cumprod(self.power, out=self.power)
        np.cumprod(self.inverse, out=self.inverse)

    def over(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def _packed(start: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Start of the first window, its distance to the trigger and the number of windows, in one long."""
    return (start.astype(np.int64) << 17) | (a.astype(np.int64) << 8) | n.astype(np.int64)


def segments(texts: list) -> Iterator[list[tuple[int, int, bytes]]]:
    """(number of the text, offset, bytes) in groups of about SEGMENT_BYTES; short texts left out."""
    held, out = 0, []
    for k, body in enumerate(texts):
        if body is None or len(body) < LENGTH:
            continue
        for at in range(0, len(body) - LENGTH + 1, SEGMENT_BYTES):
            part = body[at : at + SEGMENT_BYTES + LENGTH - 1]
            if held and held + len(part) > 2 * SEGMENT_BYTES:
                yield out
                held, out = 0, []
            out.append((k, at, part))
            held += len(part)
    if out:
        yield out


class Parser:
    def __init__(self) -> None:
        most = 3 * SEGMENT_BYTES
        self.one, self.two = Rolling(most, 0), Rolling(most, 1)

    def parts(self, group: list[tuple[int, int, bytes]]) -> dict[str, np.ndarray]:
        """The parts of all phrases: text number, start (first window), a (its distance to the trigger), n (windows), core, f1, f2."""
        data = np.frombuffer(b"".join(s for _, _, s in group), np.uint8)
        lengths = np.array([len(s) for _, _, s in group])
        begins = np.cumsum(lengths) - lengths
        self.one.over(data)
        self.two.over(data)
        at = np.arange(len(data) - GRAM + 1)
        key = (_mixed(self.one.of(at, at + GRAM)) & ~_POSITION) | at.astype(np.uint64)
        # Smallest over the grams of a window, by doubling.
        grams, width = LENGTH - GRAM + 1, 1
        while 2 * width <= grams:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        key = np.minimum(key[: len(key) - (grams - width)], key[grams - width :])
        windows = lengths - LENGTH + 1
        starts = np.repeat(begins - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        trigger = (key[starts] & _POSITION).astype(np.int64)
        cut = np.flatnonzero((np.diff(trigger) != 0) | (np.diff(starts) != 1)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [len(starts)]]) - 1
        t = trigger[first]
        near, far = t - starts[last], t - starts[first]
        lo, hi = near // PART, far // PART
        n = hi - lo + 1
        phrase = np.repeat(np.arange(len(t)), n)
        block = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        t = t[phrase]
        low, high = np.maximum(near[phrase], block * PART), np.minimum(far[phrase], block * PART + PART - 1)
        core = t - block * PART
        start, end = t - high, t - low + LENGTH
        salt = _mixed((block * 1024 + high).astype(np.uint64) * np.uint64(1024) + low.astype(np.uint64))
        which = np.searchsorted(begins, start, side="right") - 1
        return {
            "text": np.array([k for k, _, _ in group])[which],
            "place": _packed(start - begins[which] + np.array([o for _, o, _ in group])[which], high, high - low + 1),
            "core": _mixed(self.one.of(core, core + LENGTH - PART + 1) + block.astype(np.uint64)).view(np.int64),
            "f1": _mixed(self.two.of(start, end) ^ salt).view(np.int64),
        }

    def split(self, body: bytes, place: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, core and f1 of the narrower parts of a part of ``body``."""
        begin, a, n = place >> 17, (place >> 8) & 511, place & 255
        data = np.frombuffer(body, np.uint8, n - 1 + LENGTH, begin)
        self.one.over(data)
        self.two.over(data)
        distance = np.arange(a - n + 1, a + 1)
        block = np.unique(distance // width)
        low, high = np.maximum(a - n + 1, block * width), np.minimum(a, block * width + width - 1)
        start, end = a - high, a - low + LENGTH
        core = a - block * width
        salt = _mixed((block * 1024 + high).astype(np.uint64) * np.uint64(1024) + low.astype(np.uint64))
        if width == 1:  # windows are compared whatever their distance
            block, salt = np.zeros_like(block), np.zeros_like(salt)
        cores = _mixed(self.one.of(core, core + LENGTH - width + 1) + block.astype(np.uint64)).view(np.int64)
        return _packed(begin + start, high, high - low + 1), cores, _mixed(self.two.of(start, end) ^ salt).view(np.int64)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    body = F.col(text).cast("string")
    return docs.withColumns({"_k1": F.xxhash64(body), "_k2": F.xxhash64(F.lit(1), body), "_body": body})


PARTS = "_k1 bigint, _k2 bigint, place bigint, core bigint, f1 bigint"


def _parts(keyed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        names = [f.split()[0] for f in PARTS.split(", ")]
        for batch, texts in slices(batches, "_body"):
            keys = [batch.column(c).to_numpy() for c in ("_k1", "_k2")]
            for group in segments(texts):
                p = parser.parts(group)
                columns = [*[k[p["text"]] for k in keys], *[p[c] for c in names[2:]]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return keyed.select("_k1", "_k2", "_body").mapInArrow(run, PARTS)


def _texts(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """_k1, _k2 and _body of the distinct texts that may be among ``wanted``'s (by their key filter)."""
    bits = keyed.sparkSession.sparkContext.broadcast(key_filter(wanted, "_k1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(bits.value, batch.column("_k1").to_numpy())))

    rows = keyed.select("_k1", "_k2", "_body")
    return rows.mapInArrow(run, rows.schema).dropDuplicates(["_k1", "_k2"])


def _narrower(keyed: DataFrame, mixed: DataFrame, width: int) -> DataFrame:
    """The parts in ``mixed`` split into parts of ``width`` distances; ``alone`` is handed down."""
    lists = mixed.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("place", "alone")).alias("parts"))
    lists = stored(lists, "lists")
    rows = _texts(keyed, lists).join(lists, ["_k1", "_k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        names = [*[f.split()[0] for f in PARTS.split(", ")], "alone"]
        for batch, texts in slices(batches, "_body"):
            for k1, k2, body, parts in zip(
                batch.column("_k1").to_pylist(), batch.column("_k2").to_pylist(), texts, batch.column("parts").to_pylist(), strict=True
            ):
                out = []
                for part in parts:
                    made = parser.split(body, part["place"], width)
                    out.append((*made, np.full(len(made[0]), part["alone"])))
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                n = len(columns[0])
                columns = [np.full(n, k1, np.int64), np.full(n, k2, np.int64), *columns]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return rows.mapInArrow(run, f"{PARTS}, alone boolean")


def _settled(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeated parts, distinct parts that have to be split); ``parts`` are alone (seen once) or stand for several."""
    entries = parts.groupBy("core", "f1").agg(
        F.sum(F.when(F.col("alone"), F.lit(1)).otherwise(F.lit(2))).alias("_seen"), F.min(F.struct("_k1", "_k2", "place")).alias("at")
    )
    entries = stored(entries, "entries")
    again = entries.where("_seen > 1").select("core", "f1")
    # Equal texts have equal parts: their rows fall together here.
    repeated = parts.where("alone").join(again, ["core", "f1"], "left_semi").select("_k1", "_k2", "place").distinct()
    groups = entries.groupBy("core").agg(F.count(F.lit(1)).alias("_entries"), F.min("_seen").alias("_least"))
    mixed = entries.join(groups.where("_entries > 1 and _least = 1").select("core"), "core", "left_semi")
    return repeated, mixed.select("at.*", (F.col("_seen") == 1).alias("alone"))


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """_k1, _k2 and spans (array of start and end) of the texts with repeats."""
    parts = stored(_parts(keyed), "parts")
    cores = parts.groupBy("core").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("core")
    shared = stored(parts.join(cores, "core", "left_semi").withColumn("alone", F.lit(True)), "shared")
    found, mixed = _settled(shared)
    for width in WIDTHS[1:]:
        narrow = stored(_narrower(keyed, mixed, width), "narrower")
        more, mixed = _settled(narrow)
        found = found.union(more)
    start, n = F.shiftright("place", 17), F.col("place").bitwiseAND(255)
    span = F.struct(start.alias("start"), (start + n - 1 + LENGTH).alias("end"))
    return found.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["end"]))
        else:
            out.append((s["start"], s["end"]))
    return out


CUT = (
    "_k1 bigint, _k2 bigint, _removed bigint, _spans bigint, _sha string, "
    "removed array<struct<start:bigint,end:bigint>>, kept binary"
)


def _cut(keyed: DataFrame, spans: DataFrame, with_bytes: bool) -> DataFrame:
    rows = _texts(keyed, spans).join(spans, ["_k1", "_k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CUT.split(", ")]
        for batch, texts in slices(batches, "_body"):
            out = []
            for k1, k2, body, spans in zip(
                batch.column("_k1").to_pylist(), batch.column("_k2").to_pylist(), texts, batch.column("spans").to_pylist(), strict=True
            ):
                runs = _merged(spans)
                ends = [0, *[e for _, e in runs]]
                kept = b"".join(body[s:e] for s, e in zip(ends, [*[s for s, _ in runs], len(body)], strict=True))
                out.append(
                    (k1, k2, len(body) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(),
                     [{"start": s, "end": e} for s, e in runs], kept if with_bytes else None)
                )
            types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return rows.mapInArrow(run, CUT)


def remove_repeats(docs: DataFrame, text: str = "text", keep: list[str] | None = None, with_bytes: bool = False) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all but the text) with RESULTS, and the bytes left as ``kept`` if asked for.

    ``removed`` lists the removed runs (byte offsets, end exclusive). Cutting may split characters.
    """
    kept = [c for c in without(docs, [*RESULTS, "kept"]).columns if c != text] if keep is None else keep
    keyed = _keyed(docs, text)
    spans = stored(repeated_spans(keyed), "spans")
    cut = stored(_cut(keyed, spans, with_bytes), "cut")
    body = F.coalesce(F.col("_body"), F.lit("")).cast("binary")
    plain = keyed.select(
        *[F.col(f"`{c}`") for c in kept], "_k1", "_k2", F.length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("_all"),
        *([body.alias("_bytes")] if with_bytes else []),
    )
    counts = plain.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_rows"))
    joined = hot_join(plain, cut, ["_k1", "_k2"], counts, "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        *[F.col(f"`{c}`") for c in kept],
        "n_bytes",
        F.coalesce("_removed", zero).alias("n_removed"),
        F.coalesce("_spans", zero).alias("n_spans"),
        F.coalesce("_sha", "_all").alias("kept_sha256"),
        F.coalesce("removed", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("removed"),
        *([F.coalesce("kept", "_bytes").alias("kept")] if with_bytes else []),
    )
