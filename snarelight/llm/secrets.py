"""Secret scan by token efficiency.

A subword vocabulary spends few tokens on natural words and many on random strings, so a long run
with few characters per token under a tiktoken vocabulary is random. Known digests (hex of a usual
digest's length) and identifiers (UUIDs, numbers, words joined by dashes or slashes) are left out
of that test. Assignments, access keys and long hex are always reported.

Spans are (kind, start, end) in code points, end exclusive. Null and empty texts have no spans;
repeated rows are scanned alike; empty tables give empty results; texts are scanned whole, one at a
time. Input columns with the name of a result are replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snarelight.llm.common import slices, without

#: In the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "random")
RESULTS = ["spans"]
#: Shortest run that is tested, and the characters per token below which it is random.
RUN_CHARS = 20
RATIO = 2.2
DIGEST_CHARS = {32, 40, 48, 56, 64, 96, 128}

_ASSIGN = re.compile(
    rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ASSIGN_CUES = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_RUN = re.compile(rb"[A-Za-z0-9+/=_-]+")
_UUID = re.compile(rb"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_HEX_ANY = re.compile(rb"[0-9a-f]+|[0-9A-F]+")
_WORDS = re.compile(rb"[/_=-]*([A-Za-z]?[a-z]+|[A-Z]+|[0-9]+)([/_=-]+([A-Za-z]?[a-z]+|[A-Z]+|[0-9]+))*[/_=-]*")
_CLASSES = (re.compile(rb"[a-z]"), re.compile(rb"[A-Z]"), re.compile(rb"[0-9]"))
#: Byte maps that turn a run of a class into a run of one letter, to look for long runs fast.
_AS_HEX = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_AS_RUN = bytes(
    104 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-" else 32 for b in range(256)
)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) in bytes."""
    out = []
    low = text.lower()
    if any(cue in low for cue in _ASSIGN_CUES):
        out += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if b"AKIA" in text:
        out += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in text.translate(_AS_HEX):
        out += [(2, m.start(), m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return out


def is_known(run: bytes) -> bool:
    """Digests and identifiers, which look random and are no secrets."""
    if run.isdigit() or _UUID.fullmatch(run) or _WORDS.fullmatch(run):
        return True
    return len(run) in DIGEST_CHARS and _HEX_ANY.fullmatch(run) is not None


def random_spans(text: bytes, tokens: Callable[[bytes], int], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of low token efficiency that meet no span of ``taken``."""
    if b"h" * RUN_CHARS not in text.translate(_AS_RUN):
        return []
    out = []
    for m in _RUN.finditer(text):
        run = m[0]
        if len(run) < RUN_CHARS or sum(c.search(run) is not None for c in _CLASSES) < 2 or is_known(run):
            continue
        if any(s < m.end() and m.start() < e for _, s, e in taken):
            continue
        if len(run) < RATIO * tokens(run):
            out.append((3, m.start(), m.end()))
    return out


def vocabulary(path: str) -> bytes:
    """The vocabulary file; read on the driver and sent to the executors (under 1 MB)."""
    with open(path, "rb") as file:
        return file.read()


def counter(ranks: bytes, pattern: str) -> Callable[[bytes], int]:
    """Counts a string's tokens; the vocabulary is only built when first used."""
    made: list = []

    def count(run: bytes) -> int:
        if not made:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
            made.append(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}))
        return len(made[0].encode_ordinary(run.decode()))

    return count


def scan(docs: DataFrame, text: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end), by start and then kind."""
    sent = docs.sparkSession.sparkContext.broadcast(
        vocabulary(vocabulary_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    )
    pattern = public_tokenizers.PATTERN
    base = without(docs, RESULTS)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(sent.value, pattern)
        for batch, texts in slices(batches, text):
            found = []
            for body in texts:
                spans = base_spans(body) if body else []
                spans += random_spans(body, tokens, spans) if body else []
                spans.sort(key=lambda s: (s[1], s[0]))
                found.append(in_code_points(body, spans))
            at = batch.schema.names.index("spans")
            columns = list(batch.columns)
            columns[at] = pa.array(found, pa.list_(kind))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    empty = base.withColumn("spans", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))
    return empty.mapInArrow(run, empty.schema)


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[dict]:
    out, at, points = [], 0, 0
    for kind, start, end in spans:  # by start
        points += len(text[at:start].decode())
        at = start
        out.append({"kind": KINDS[kind], "start": points, "end": points + end - start})  # spans are ASCII
    return out
