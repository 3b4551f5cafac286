"""Spelling variants: words one edit apart, by pairs of trie nodes.

All prefixes of the dictionary's words are the nodes of a trie, all suffixes those of a trie of the
reversed words; both are numbered. A word without its i-th letter is the pair (node of the letters
before i, node of those after i), and a word split at i is the pair of its two parts. Two words that
leave the same pair without a letter differ by a replaced letter; a word that leaves the pair of
another one's split has one letter more. So equality of integer pairs gives exactly the neighbours.

Nodes are numbered in one pass over the sorted words: a word has new nodes from where it leaves the
word before. Partitions are numbered from 1 each; the driver sees their first and last word, and from
these what a partition inherits from the one before (at most a word's length per partition).

Words that leave one pair differ in a single letter, so a pair has at most as many as there are
letters (``LETTERS``), and one word that is split there: nothing can grow hot, whatever the counts of
the words. Counts cover all texts. A word's form is its most frequent neighbour (ties: the smallest
by code points) if that is ``RATIO`` times as frequent; roots follow forms by pointer jumping.

Null and empty texts have no words; equal texts count as often as they occur; very long texts and
words are used whole. Empty tables give empty results. The document table's columns other than text
and id are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snarelight.llm.common import slices, stored
from snarelight.operators.positions import with_index

#: A word's letters, after A-Z are lowered.
LETTERS = r"a-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
FLUSH_WORDS = 300_000
#: From a document's id and the counts of its words to the words and counts that are used instead.
Change = Callable[[bytes, Counter], Iterable[tuple[str, int]]]


def word_counts(docs: DataFrame, text: str, doc_id: str | None = None, change: Change | None = None, letters: int = LEAST_LETTERS) -> DataFrame:
    """word and n: how often each word of ``letters`` code points or more occurs in all texts.

    ``change`` may put other words in the place of a document's own.
    """
    pattern = re.compile(f"[{LETTERS}]{{{letters},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch, texts in slices(batches, "_text"):
            ids = batch.column("_id").cast(pa.binary()).to_pylist()
            for own, body in zip(ids, texts, strict=True):
                # bytes.lower knows A-Z only.
                found = pattern.findall((body or b"").lower().decode("utf-8", "replace"))
                if change is None:
                    counts.update(found)
                else:
                    for word, n in change(own or b"", Counter(found)):
                        counts[word] += n
            if len(counts) > FLUSH_WORDS:
                yield _counted(counts)
                counts = Counter()
        if counts:
            yield _counted(counts)

    own = F.lit("") if doc_id is None else F.col(f"`{doc_id}`").cast("string")
    rows = docs.select(own.alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    return rows.mapInArrow(run, "word string, n bigint").where(F.length("word") >= letters).groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])


def drop_letter(every: int) -> Change:
    """Deletes one letter where crc32 of 'id:word' is a multiple of ``every``: a misspelling that reruns alike."""

    def change(own: bytes, counts: Counter) -> Iterator[tuple[str, int]]:
        start = zlib.crc32(own + b":")
        for word, n in counts.items():
            h = zlib.crc32(word.encode(), start)
            if h % every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            yield word, n

    return change


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class _Trie:
    """Numbers the nodes of sorted words as they come, from ``first``; ``path`` has those of the last word's prefixes."""

    def __init__(self, word: str = "", path: list[int] | None = None, first: int = 1) -> None:
        self.word, self.path, self.next = word, path or [0], first

    def add(self, word: str) -> list[int]:
        same = _shared(self.word, word)
        new = len(word) - same
        self.path = [*self.path[: same + 1], *range(self.next, self.next + new)]
        self.word, self.next = word, self.next + new
        return self.path


def trie_nodes(words: DataFrame, key: str, nodes: str) -> DataFrame:
    """``words`` (``word_id`` and the distinct strings ``key``) as word_id and ``nodes``: the numbers of the key's prefixes, from the root (0)."""
    # Spark orders strings by their UTF-8 bytes, which is the order of code points.
    placed = words.select("word_id", key).repartitionByRange(key).sortWithinPartitions(key)
    ranged = stored(placed.withColumn("_part", F.spark_partition_id()), "sorted-words")

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[int, tuple[str, _Trie]] = {}
        for batch in batches:
            for part, word in zip(batch.column("_part").to_pylist(), batch.column(key).to_pylist(), strict=True):
                if part not in tries:
                    tries[part] = (word, _Trie())
                tries[part][1].add(word)
        rows = [(p, first, t.word, t.path, t.next - 1) for p, (first, t) in tries.items()]
        if rows:
            types = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["part", "first", "last", "path", "n"]
            )

    # A file of the stored table holds one partition, in order; a part never spans tasks (see _whole_parts).
    rows = _whole_parts(ranged, key).mapInArrow(summary, "part int, first string, last string, path array<bigint>, n bigint")
    starts: dict[int, tuple[str, list[int], int]] = {}
    word, path, base = "", [0], 1
    for r in sorted(rows.collect(), key=lambda r: r["part"]):
        same = _shared(word, r["first"])
        starts[r["part"]] = (word[:same], path[: same + 1], base)
        # Of the nodes numbered in the part alone, the first ``same`` are inherited.
        path = [path[x] if x <= same else base + x - same - 1 for x in r["path"]]
        word, base = r["last"], base + r["n"] - same
    sent = words.sparkSession.sparkContext.broadcast(starts)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[int, _Trie] = {}
        for batch in batches:
            out = []
            for part, word in zip(batch.column("_part").to_pylist(), batch.column(key).to_pylist(), strict=True):
                if part not in tries:
                    tries = {part: _Trie(*sent.value[part])}
                out.append(tries[part].add(word))
            yield pa.RecordBatch.from_arrays([batch.column("word_id"), pa.array(out, pa.list_(pa.int64()))], names=["word_id", nodes])

    return _whole_parts(ranged, key).mapInArrow(number, f"word_id bigint, {nodes} array<bigint>")


def _whole_parts(ranged: DataFrame, key: str) -> DataFrame:
    """The sorted parts, each whole and in order in one task, however the files were cut."""
    return ranged.repartition("_part").sortWithinPartitions("_part", key)


def _pairs(nodes: DataFrame) -> DataFrame:
    """x, y (nodes), word_id, n, kind of every word's pairs: 0 a skip, 1 a skip that stands for a deletion, 2 a split.

    Of equal letters in a row only the first is deleted: any other one leaves the same word.
    """
    size = F.length("word")
    skips = nodes.select(
        "word_id", "n", "word", "before", "after", F.explode(F.sequence(F.lit(0), size - 1)).alias("i")
    )
    letter = lambda at: F.substring("word", at, 1)
    first = (F.col("i") == 0) | (letter(F.col("i") + 1) != letter(F.greatest(F.col("i"), F.lit(1))))
    skips = skips.select(
        F.get("before", F.col("i")).alias("x"),
        F.get("after", F.length("word") - F.col("i") - 1).alias("y"),
        "word_id",
        "n",
        first.cast("int").alias("kind"),
    )
    splits = nodes.select("word_id", "n", "word", "before", "after", F.explode(F.sequence(F.lit(0), size)).alias("i")).select(
        F.get("before", F.col("i")).alias("x"), F.get("after", F.length("word") - F.col("i")).alias("y"), "word_id", "n", F.lit(2).alias("kind")
    )
    return skips.unionByName(splits)


def neighbours(nodes: DataFrame) -> DataFrame:
    """word_id, n_near and best (struct of -n and word_id of the most frequent neighbour) of words that have any."""
    entry = F.struct((-F.col("n")).alias("less"), F.col("word_id").alias("word_id"), F.col("kind"))
    # At most one entry per letter and one split in a group.
    groups = _pairs(nodes).groupBy("x", "y").agg(F.sort_array(F.collect_list(entry)).alias("members")).where(F.size("members") > 1)
    skipped = F.filter("members", lambda m: m["kind"] < 2)
    deleted = F.filter("members", lambda m: m["kind"] == 1)
    split = F.filter("members", lambda m: m["kind"] == 2)
    groups = groups.select(skipped.alias("skipped"), deleted.alias("deleted"), split.alias("split"))
    bare = lambda m: F.struct(m["less"].alias("less"), m["word_id"].alias("word_id"))

    def near(word_id: Column, n: Column, best: Column) -> Column:
        return F.struct(word_id.alias("word_id"), n.cast("long").alias("near"), best.alias("best"))

    # Members are sorted by falling count, so the best other one is the first, or the second of the first.
    replaced = F.when(
        F.size("skipped") > 1,
        F.transform(
            "skipped",
            lambda m, i: near(m["word_id"], F.size("skipped") - 1, bare(F.get("skipped", F.when(i == 0, 1).otherwise(0)))),
        ),
    )
    shorter = F.when(F.size("split") > 0, F.transform("deleted", lambda m: near(m["word_id"], F.lit(1), bare(F.get("split", F.lit(0))))))
    longer = F.when(
        F.size("deleted") > 0, F.transform("split", lambda m: near(m["word_id"], F.size("deleted"), bare(F.get("deleted", F.lit(0)))))
    )
    none = F.array().cast("array<struct<word_id:bigint,near:bigint,best:struct<less:bigint,word_id:bigint>>>")
    found = groups.select(F.explode(F.concat(*[F.coalesce(x, none) for x in (replaced, shorter, longer)])).alias("f")).select("f.*")
    return found.groupBy("word_id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word_id and root_id; ``forms`` has word_id and form_id (null: none). Counts rise along forms, so there are no rings."""
    found = stored(forms.select("word_id", F.coalesce("form_id", "word_id").alias("root_id")), "roots")
    while True:
        up = found.select(F.col("word_id").alias("root_id"), F.col("root_id").alias("above"))
        further = stored(found.join(up, "root_id").select("word_id", F.col("above").alias("root_id"), (F.col("above") != F.col("root_id")).alias("moved")), "roots")
        if further.where("moved").isEmpty():
            return further.select("word_id", "root_id")
        found = further.select("word_id", "root_id")


def variants(
    docs: DataFrame,
    text: str = "text",
    doc_id: str | None = None,
    change: Change | None = None,
    letters: int = LEAST_LETTERS,
    least: int = LEAST_COUNT,
    ratio: int = RATIO,
) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of ``letters`` code points or more with ``least`` occurrences."""
    counted = word_counts(docs, text, doc_id, change, letters).where(F.col("n") >= least)
    # Numbers follow the order of code points, so the smallest word of a tie has the smallest number.
    words = stored(with_index(counted, [F.col("word")], "word_id"), "words")
    before = trie_nodes(words, "word", "before")
    after = trie_nodes(words.select("word_id", F.reverse("word").alias("_reversed")), "_reversed", "after")
    nodes = words.join(before, "word_id").join(after, "word_id")
    near = stored(words.join(neighbours(nodes), "word_id", "left"), "near")
    form = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best"))
    near = near.select("word_id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"))
    near = stored(near.select("word_id", "word", "n", "n_near", F.col("form.word_id").alias("form_id"), (-F.col("form.less")).alias("form_n")), "forms")
    # Words without a form look up themselves, so that they don't meet at one key.
    names = near.select(F.col("word_id").alias("_id"), F.col("word").alias("_name"))
    out = near.join(roots(near), "word_id").withColumn("_id", F.coalesce("form_id", "word_id")).join(names, "_id")
    out = out.withColumn("form", F.when(F.col("form_id").isNotNull(), F.col("_name"))).drop("_id", "_name")
    out = out.withColumnRenamed("root_id", "_id").join(names, "_id").withColumnRenamed("_name", "root")
    return out.select("word", "form", "root", "n", "n_near", "form_n")
