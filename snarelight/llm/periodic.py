"""Runs of periodic words, by a suffix automaton and link-cut access.

A run is a stretch of words with smallest period q, of at least ``times`` periods and ``least`` words,
that neither neighbour extends. Words are numbered, and the suffix automaton of a stretch gives the
tree of suffix links, in which the path from the root to a prefix's state holds all its suffixes.
Words are appended in turn: the access of a link-cut tree gives the path of the new end one colour,
its last occurrence, and passes the path segments that had others. Where a segment's longest suffix
last ended d words before and is at least as long as d, the two occurrences make a square of period
d, at its leftmost start; squares with enough periods are extended to both sides to runs.

Only stretches in which a run can lie go through the automaton. In a run all words after the first
period have an equal word at most q before, and there are at least (times - 1) q and least - q such
words, so a stretch of m words in a row with earlier equal ones is split wherever the nearest of
these is more than m / (times - 1) before, until nothing splits; no run is lost. Both steps take
time of n log n words and memory of n, about 600 bytes for each word of a stretch.

Words are split at the six ASCII white space characters and compared as they are written. A null text
counts as empty and has no words and no runs. Equal texts have equal runs, and repeated rows are
treated each. Very long texts are used whole. Empty tables give empty results. Input columns with
the name of a result are replaced; columns of any other name are kept, also those with dots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snarelight.llm.common import arrow_slices, packed, split_words, unpacked, without

LEAST, TIMES = 24, 3
RESULTS = ["n_words", "runs", "collapsed"]
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and length of each state (0: the empty word), and the state of each prefix."""
    moves: list[dict[int, int]] = [{}]
    link, length, ends, last = [-1], [0], [], 0
    for word in words:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and word not in moves[p]:
            moves[p][word] = state
            p = link[p]
        if p >= 0:
            q = moves[p][word]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                part = len(moves)
                moves.append(moves[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(word) == q:
                    moves[p][word] = part
                    p = link[p]
                link[q] = link[state] = part
        ends.append(state)
        last = state
    return link, length, ends


class Paths:
    """A link-cut tree over suffix links; every preferred path has one colour, kept at the root of its splay tree.

    State 0 stands for no node. Nothing is ever re-rooted, so there is nothing to push down.
    """

    def __init__(self, link: list[int]) -> None:
        self.above = [max(x, 0) for x in link]
        self.left, self.right, self.colour = ([0] * len(link) for _ in range(3))
        self.left[0] = self.right[0] = -1

    def _rotate(self, x: int) -> None:
        above, left, right = self.above, self.left, self.right
        f = above[x]
        g = above[f]
        if left[f] == x:
            b = left[f] = right[x]
            right[x] = f
        else:
            b = right[f] = left[x]
            left[x] = f
        if b:
            above[b] = f
        above[f], above[x] = x, g
        if left[g] == f:
            left[g] = x
        elif right[g] == f:
            right[g] = x
        else:
            self.colour[x] = self.colour[f]

    def _splay(self, x: int) -> None:
        above, left, right = self.above, self.left, self.right
        while True:
            f = above[x]
            if left[f] != x and right[f] != x:
                return
            g = above[f]
            if left[g] == f:
                self._rotate(f if left[f] == x else x)
            elif right[g] == f:
                self._rotate(f if right[f] == x else x)
            self._rotate(x)

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Gives the path of ``node`` the colour; (colour before, lowest node) of its segments, from below."""
        above, right = self.above, self.right
        out, below, x = [], 0, node
        while x:
            self._splay(x)
            old = self.colour[x]
            if old:
                out.append((old, x))
            if right[x]:
                self.colour[right[x]] = old
            right[x] = below
            below, x = x, above[x]
        self._splay(node)
        self.colour[node] = colour
        return out


def squares(words: list[int], least: int = LEAST, times: int = TIMES) -> dict[tuple[int, int], int]:
    """(start, period) to end (exclusive) of the longest stretches of ``times`` periods and ``least`` words."""
    link, length, ends = automaton(words)
    paths, found = Paths(link), {}
    for end, state in enumerate(ends, 1):
        for before, lowest in paths.access(state, end):
            period, shared = end - before, length[lowest]
            if shared >= (times - 1) * period and shared + period >= least:
                found[end - period - shared, period] = end
    return found


def _stretches(ok: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal stretches of True that cross no text's start."""
    edges = np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    inner = starts[ok[starts] & (starts > 0)] if len(ok) else starts
    inner = inner[ok[inner - 1]]
    return np.sort(np.concatenate([begins, inner])), np.sort(np.concatenate([ends, inner]))


def stretches(numbers: np.ndarray, starts: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Begin and end of the parts of the texts in which runs can lie; ``starts`` are those of texts with words."""
    order = np.argsort(numbers, kind="stable")
    back = np.full(len(numbers), len(numbers) + 1, np.int64)
    same = numbers[order[1:]] == numbers[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    own = starts[np.searchsorted(starts, np.arange(len(numbers)), side="right") - 1] if len(starts) else starts
    ok = np.arange(len(numbers)) - back >= own
    shortest = -(-least * (times - 1) // times)
    begins, ends = _stretches(ok, starts)
    while True:
        long = ends - begins >= shortest
        begins, ends = begins[long], ends[long]
        size = ends - begins
        first = np.cumsum(size) - size
        # Places of all stretches, one after the other.
        at = np.repeat(begins - first, size) + np.arange(size.sum())
        fits = back[at] <= np.repeat(size // (times - 1), size)
        if fits.all():
            reach = np.maximum(begins - size // (times - 1), own[begins] if len(begins) else 0)
            return list(zip(reach.tolist(), ends.tolist(), strict=True))
        cut_begins, cut_ends = _stretches(fits, first)
        begins, ends = at[cut_begins], at[cut_ends - 1] + 1


def runs_of(numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Per text (its words from ``starts`` to ``ends`` of ``numbers``): its runs as (start, length, period), sorted."""
    out: list[set] = [set() for _ in starts]
    full = np.flatnonzero(ends > starts)
    for begin, end in stretches(numbers, starts[full], least, times):
        text = full[np.searchsorted(starts[full], begin, side="right") - 1]
        low, high = int(starts[text]), int(ends[text])
        words = numbers[low:high].tolist()
        for (start, period), stop in squares(words[begin - low : end - low], least, times).items():
            start, stop = start + begin - low, stop + begin - low
            while start > 0 and words[start - 1] == words[start - 1 + period]:
                start -= 1
            while stop < len(words) and words[stop] == words[stop - period]:
                stop += 1
            out[text].add((start, stop - start, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def find_runs(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, least: int = LEAST, times: int = TIMES
) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all but the text) with n_words, runs and collapsed.

    ``runs`` lists start (word number), length and period in words, by start and period. ``collapsed``
    is the text, one space between words, without the words that a run contains after its first period.
    """
    kept = [c for c in without(docs, RESULTS).columns if c != text] if keep is None else keep
    rows = docs.select(
        packed(kept),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("collapsed"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>").alias("runs"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, 1):
            words, counts = split_words(batch.column(1))
            ends = np.cumsum(counts)
            starts = ends - counts
            numbers = words.dictionary_encode().indices.to_numpy()
            runs = runs_of(numbers, starts, ends, least, times)
            keeps = np.ones(len(numbers), bool)
            for begin, found in zip(starts.tolist(), runs, strict=True):
                for start, length, period in found:
                    keeps[begin + start + period : begin + start + length] = False
            left = np.concatenate([[0], np.cumsum(keeps)])[np.concatenate([[0], ends])]
            lists = pa.LargeListArray.from_arrays(pa.array(left), words.filter(pa.array(keeps)))
            made = [
                pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(batch.column(1).type),
                pa.array(counts, pa.int64()),
                pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], pa.list_(_RUN)),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], schema=batch.schema)

    return rows.mapInArrow(run, rows.schema).select(*unpacked(kept), "n_words", "runs", "collapsed")
