"""Chat formatting over a prefix tree of conversations.

Conversations that share their first turns share the nodes of those turns: a node is a turn with
all turns before it, named by a chained digest. Conversations are ordered by their paths of nodes,
which makes the order of new nodes the depth-first order of the tree, and each node's tokens are
emitted once, by the first conversation that has it. A node carries its place in the emitted
stream, the position id of its first token (tokens of its ancestors), whether its text is under
the loss mask, and the stream intervals its tokens may attend to: its ancestors.

A turn is written ``### role: text </turn>`` and a line break; backslash, ``#`` and ``<`` (and ``:``
in roles) inside texts get a backslash, so no text can hold a control string and reading back is
exact. Turns are ordered by turn, then role and text (nulls first); equal rows are turns of their own.
Null texts and roles are empty; rows without conv_id form one conversation. Empty tables give
empty results. Extra columns are ignored. A conversation's path (16 bytes a turn) must fit a row;
its texts are streamed.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snarelight.llm.common import hot_join, stored, with_running_totals

LOSS_ROLE = "assistant"
END = " </turn>\n"
_TEXT = re.compile(r"([\\#<])")
_ROLE = re.compile(r"([\\#<:])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_SEGMENT = re.compile(r"### ((?:[^\\:]|\\.)*): (.*) </turn>\n", re.DOTALL)

TURNS = "conv_id bigint, conv_key string, place bigint, node binary, parent binary, role string, segment string, n_tokens bigint, position bigint, path binary"


def segment(role: str, text: str) -> str:
    return f"### {_ROLE.sub(r'\\\1', role)}: {_TEXT.sub(r'\\\1', text)}{END}"


def parsed(written: str) -> tuple[str, str]:
    """Role and text of a segment."""
    m = _SEGMENT.fullmatch(written)
    if m is None:
        raise ValueError("not a turn of this template")
    return _ESCAPED.sub(r"\1", m[1]), _ESCAPED.sub(r"\1", m[2])


def _encoder(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def _turns(conversations: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Each turn with its node, its place and position; a conversation's last turn has its path."""
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv_key"),
        F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    rows = rows.repartition("conv_key").sortWithinPartitions("conv_key", "turn", "role", "text").drop("turn")
    sent = conversations.sparkSession.sparkContext.broadcast(ranks)
    names = [f.split()[0] for f in TURNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoder(sent.value, pattern)
        held: list | None = None  # the last row waits until it is known whether its conversation goes on
        node, path, place, position = b"", bytearray(), 0, 0
        for batch in batches:
            out = []
            for conv_id, key, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or held[1] != key:
                    if held is not None:
                        held[9] = bytes(path)
                        out.append(held)
                    node, path, place, position = b"", bytearray(), 0, 0
                else:
                    out.append(held)
                written = segment(role or "", text or "")
                parent, node = node, hashlib.blake2b(node + written.encode(), digest_size=16).digest()
                path += node
                n = len(encoding.encode_ordinary(written))
                held = [conv_id, key, place, node, parent, role or "", written, n, position, None]
                place, position = place + 1, position + n
            if out:
                yield _batch(out, names)
        if held is not None:
            held[9] = bytes(path)
            yield _batch([held], names)

    return rows.mapInArrow(run, TURNS)


def _batch(rows: list, names: list[str]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in TURNS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def format_chats(conversations: DataFrame, ranks: bytes, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths).

    nodes: one row per node of the prefix tree: node, parent, role, segment, loss, n_tokens, stream_start
    and stream_end (tokens), position (of its first token) and attends (stream intervals of its
    ancestors, ascending; the node's own tokens attend to those and causally to each other).
    paths: conv_id, conv_key, place, node, for each turn of each conversation.
    """
    turns = stored(_turns(conversations, ranks, pattern), "turns")
    # Order of paths = depth-first order of the tree; equal conversations in order of their keys.
    order = with_running_totals(
        turns.where("path is not null").select("conv_key", "path"), [F.col("path"), F.col("conv_key")], {"seq": F.lit(1).cast("long")}
    ).drop("path")
    sizes = turns.groupBy("conv_key").agg(F.count(F.lit(1)).alias("_rows"))
    narrow = turns.drop("segment", "path", "role")
    ranked = stored(hot_join(narrow, order, ["conv_key"], sizes), "ranked")
    owners = ranked.groupBy("node").agg(F.min("seq").alias("owner"), F.count(F.lit(1)).alias("_rows"))
    owners = stored(owners, "owners")
    owned = stored(hot_join(ranked, owners.select("node", "owner"), ["node"], owners.select("node", "_rows")), "owned")
    new = owned.where("seq = owner").select("seq", "place", "node", "parent", "n_tokens", "position", "conv_key")
    new = stored(
        with_running_totals(new, [F.col("seq"), F.col("place")], {"stream_start": F.col("n_tokens")}).withColumn(
            "stream_end", F.col("stream_start") + F.col("n_tokens")
        ),
        "nodes",
    )
    # Ancestors that an earlier conversation emitted: their intervals, joined where they touch.
    before = owned.where("seq > owner").select("seq", "place", "node")
    counts = before.groupBy("node").agg(F.count(F.lit(1)).alias("_rows"))
    spans = hot_join(before, new.select("node", "stream_start", "stream_end"), ["node"], counts)
    firsts = new.groupBy("seq").agg(F.min("stream_start").alias("run_start"))
    spans = spans.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("stream_start", "stream_end"))).alias("spans"))
    joined = F.aggregate(
        "spans",
        F.array().cast("array<struct<stream_start:bigint,stream_end:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["stream_end"] == x["stream_start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["stream_start"].alias("stream_start"), x["stream_end"].alias("stream_end"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    runs = firsts.join(spans.select("seq", joined.alias("shared")), "seq", "left")
    run_sizes = new.groupBy("seq").agg(F.count(F.lit(1)).alias("_rows"))
    new = hot_join(new, runs, ["seq"], run_sizes)
    own = F.when(
        F.col("stream_start") > F.col("run_start"),
        F.array(F.struct(F.col("run_start").alias("stream_start"), F.col("stream_start").alias("stream_end"))),
    )
    nothing = F.array().cast("array<struct<stream_start:bigint,stream_end:bigint>>")
    attends = F.concat(F.coalesce("shared", nothing), F.coalesce(own, nothing))
    placed = new.select("conv_key", "place", "node", "parent", "n_tokens", "position", "stream_start", "stream_end", attends.alias("attends"))
    texts = turns.select("conv_key", "place", "role", "segment")
    nodes = texts.join(placed, ["conv_key", "place"]).select(
        "node", "parent", "role", "segment", (F.col("role") == LOSS_ROLE).alias("loss"),
        "n_tokens", "stream_start", "stream_end", "position", "attends",
    )
    return stored(nodes, "chat"), owned.select("conv_id", "conv_key", "place", "node")


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Per conversation, from the emitted nodes alone: digests of its turns and of its text under the loss mask."""
    counts = paths.groupBy("node").agg(F.count(F.lit(1)).alias("_rows"))
    rows = hot_join(paths, nodes.select("node", "segment", "loss"), ["node"], counts).drop("node")
    rows = rows.repartition("conv_key").sortWithinPartitions("conv_key", "place")
    names = [f.split()[0] for f in READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string() if f.endswith("string") else pa.int64() for f in READ.split(", ")]
        state: list = []

        def closed() -> list:
            key, conv_id, n, turns, chars, loss, written = state
            return [conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), written]

        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "conv_key", "segment", "loss")]
            for conv_id, key, written, loss in zip(*columns, strict=True):
                if not state or state[0] != key:
                    if state:
                        out.append(closed())
                    state = [key, conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parsed(written)
                state[2] += 1
                state[3].update(f"{role}\n{text}\n".encode())
                if loss:
                    state[4] += len(text)
                    state[5].update(text.encode())
                state[6] += len(written)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(closed(), types, strict=True)], names=names)

    return rows.select("conv_id", "conv_key", "place", "segment", "loss").mapInArrow(run, READ)
