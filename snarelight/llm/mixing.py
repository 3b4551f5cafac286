"""Mixing sources to target weights along a time-varying curriculum.

Each source's weight schedule is integrated over the training time and scaled so that its
integral is the source's target of words. A document taken from a source meets its demand when
the source's words before it have been asked for: inverting the cumulative demand there gives
the document's training position in 0..1, and documents are range-sorted by position.

Whole documents are taken. A target holds some whole passes over its source and a rest; the rest
is filled with documents in hash order, each if it still fits: running totals over what fits, again
and again until nothing does (each time the first that doesn't fit goes, and all that are larger than
the room left). Last comes the smallest of the others, if going over the target by it is nearer. Documents of
one source with equal id and text are indistinguishable and taken together.

A null source is a source of its own; null texts and texts without words have size 0 and are
taken in whole passes only. Very long texts are documents like others: shorter ones fill what they leave. Without any words all targets are 0. Empty tables give empty results. Input
columns with the name of a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snarelight.llm.common import WORD, is_small, lookup_join, restored, shielded, stored, unpacked, with_running_totals, without


@dataclass(frozen=True)
class Schedule:
    """Relative weight over time, linear between knots (time, weight); times run from 0 to 1."""

    knots: tuple[tuple[float, float], ...]


#: Schedules dealt to the sources in order, repeating: steady, early to late, late to early.
CURRICULUM = (
    Schedule(((0.0, 1.0), (1.0, 1.0))),
    Schedule(((0.0, 2.0), (0.5, 1.0), (1.0, 0.5))),
    Schedule(((0.0, 0.5), (0.5, 1.0), (1.0, 2.0))),
)
WEIGHTS = (3.0, 1.0, 2.0)
RESULTS = ["size", "source_size", "target", "copies", "taken", "positions"]


def position_at(share: Column, schedule: Schedule) -> Column:
    """The time by which ``share`` of the schedule's integral has been asked for."""
    knots = schedule.knots
    pieces = [(t0, t1, r0, r1, (t1 - t0) * (r0 + r1) / 2) for (t0, r0), (t1, r1) in zip(knots, knots[1:], strict=False)]
    total = sum(p[4] for p in pieces)
    asked_for = share * F.lit(total)
    out, before = F.lit(0.0), 0.0
    for t0, t1, r0, r1, area in pieces:
        slope = (r1 - r0) / (t1 - t0)
        asked = F.greatest(asked_for - F.lit(before), F.lit(0.0))
        # Solves r0 dt + slope dt^2 / 2 = asked, in the form without cancellation.
        root = F.sqrt(F.greatest(F.lit(r0 * r0) + F.lit(2 * slope) * asked, F.lit(0.0)))
        dt = F.when(asked > 0, F.least(2 * asked / (F.lit(r0) + root), F.lit(t1 - t0))).otherwise(F.lit(0.0))
        # The outermost condition is the last piece's.
        out = F.when(asked_for >= F.lit(before), F.lit(t0) + dt).otherwise(out)
        before += area
    return out


def _sized(docs: DataFrame, text: str, doc_id: str, source: str) -> DataFrame:
    """One narrow row per document: source key, hash key, size."""
    name = F.col(source).cast("string")
    own = F.md5(
        F.concat_ws(
            ":", F.coalesce(F.col(doc_id).cast("string"), F.lit("~")), F.coalesce(F.md5(F.col(text).cast("string")), F.lit("~"))
        ).cast("binary")
    )
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    # '0' + name, and '1' for no name: code point order with null last.
    return docs.withColumns({"_src": F.coalesce(F.concat(F.lit("0"), name), F.lit("1")), "_key": own, "_size": size})


def source_targets(items: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Per source: words, target words, number in order. ``items`` has _src and _size.

    Targets are shares by weight of ``share`` times all words, no more than ``most`` times the
    source's own words. Sources in order of (cap / weight) are capped until the level that the
    others would get, (rest of the budget) / (rest of the weights), is below their cap: one
    running total instead of rounds of sharing again.
    """
    sizes = items.groupBy("_src").agg(F.sum("_size").alias("_source_size"))
    numbered = with_running_totals(sizes, [F.col("_src")], {"_number": F.lit(1)})
    places = F.array(*[F.lit(float(w)) for w in weights])
    numbered = numbered.withColumn("_weight", F.get(places, (F.col("_number") % len(weights)).cast("int")))
    cap = F.col("_source_size") * F.lit(most)
    numbered = numbered.withColumn("_cap", cap)
    ordered = with_running_totals(
        numbered, [F.col("_cap") / F.col("_weight"), F.col("_src")], {"_caps": F.col("_cap"), "_weights": F.col("_weight")}
    )
    whole = sizes.agg((F.sum("_source_size") * F.lit(share)).alias("_budget"), (F.count(F.lit(1))).alias("_sources"))
    weight_sum = numbered.agg(F.sum("_weight").alias("_all_weights"))
    ordered = ordered.join(F.broadcast(whole.join(F.broadcast(weight_sum))))
    capped = F.col("_cap") * (F.col("_all_weights") - F.col("_weights")) <= F.col("_weight") * (F.col("_budget") - F.col("_caps"))
    ordered = stored(ordered.withColumn("_capped", capped), "sources")
    level = ordered.agg(
        F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))), F.lit(0.0)).alias("_taken_caps"),
        F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_weight"))), F.lit(0.0)).alias("_taken_weights"),
    )
    free = (F.col("_budget") - F.col("_taken_caps")) / (F.col("_all_weights") - F.col("_taken_weights"))
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(free * F.col("_weight"))
    return stored(
        ordered.join(F.broadcast(level)).select("_src", "_number", "_source_size", target.alias("_target")), "targets"
    )


def plan(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    curriculum: tuple[Schedule, ...] = CURRICULUM,
) -> DataFrame:
    """Per distinct (source, key): size, source figures, copies and positions (array, one per copy)."""
    sized = _sized(docs, text, doc_id, source)
    items = stored(
        sized.groupBy("_src", "_key").agg(F.first("_size").alias("_one"), F.sum("_size").alias("_size")), "items"
    )
    targets = source_targets(items, weights, share, most)
    few = is_small(targets)
    passes = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(F.lit(0))
    state = targets.withColumn("_passes", passes.cast("long")).withColumn(
        "_rest", F.col("_target") - F.col("_passes") * F.col("_source_size")
    )
    ran = with_running_totals(items, [F.col("_src"), F.col("_key")], {"_before": F.col("_size")})
    firsts = ran.groupBy("_src").agg(F.min("_before").alias("_first"))
    state = state.join(firsts, "_src")
    placed = lookup_join(ran, state, ["_src"], "inner", spread=["_key"], small=few)
    placed = stored(placed.withColumn("_before", F.col("_before") - F.col("_first")).drop("_first"), "placed")
    zero = F.lit(0).cast("long")
    left = stored(state.select("_src", F.col("_rest").alias("_left"), zero.alias("_filled")), "left")
    # In the first round the totals over all documents serve as they are.
    totals = lookup_join(placed.select("_src", "_key", "_size", F.col("_before").alias("_run")).where("_size > 0"), left, ["_src"], "inner", spread=["_key"], small=few)
    picks, beyond = [], []
    while True:
        fits = F.col("_run") + F.col("_size") <= F.col("_left")
        judged = stored(totals.withColumn("_fits", fits), "judged")
        taken = judged.where("_fits").select("_src", "_key", (F.col("_filled") + F.col("_run")).alias("_picked_at"))
        picks.append(taken)
        used = judged.where("_fits").groupBy("_src").agg(F.sum("_size").alias("_used"))
        left = left.join(F.broadcast(used) if few else used, "_src", "left").select(
            "_src", (F.col("_left") - F.coalesce("_used", zero)).alias("_left"), (F.col("_filled") + F.coalesce("_used", zero)).alias("_filled")
        )
        left = stored(left, "left")
        others = judged.where("not _fits").select("_src", "_key", "_size")
        others = stored(lookup_join(others, left, ["_src"], "inner", spread=["_key"], small=few), "others")
        # What is larger than the room now stays so.
        beyond.append(others.where("_size > _left").select("_src", "_key", "_size"))
        fitting = others.where("_size <= _left")
        if fitting.isEmpty():
            break
        totals = with_running_totals(fitting, [F.col("_src"), F.col("_key")], {"_run": F.col("_size")})
        firsts = totals.groupBy("_src").agg(F.min("_run").alias("_first"))
        totals = lookup_join(totals, firsts, ["_src"], "inner", spread=["_key"], small=few)
        totals = totals.withColumn("_run", F.col("_run") - F.col("_first")).drop("_first")
    # Going over the target by less than what is missing.
    beyond = lookup_join(reduce(DataFrame.unionByName, beyond), left, ["_src"], "inner", spread=["_key"], small=few)
    over = beyond.where("_size - _left < _left").groupBy("_src").agg(F.min(F.struct("_size", "_key")).alias("_best"), F.first("_filled").alias("_filled"))
    over = stored(over.select("_src", "_best._key", "_best._size", F.col("_filled").alias("_picked_at")), "over")
    picks.append(over.select("_src", "_key", "_picked_at"))
    used = over.select("_src", F.col("_size").alias("_used"))
    left = stored(
        left.join(F.broadcast(used) if few else used, "_src", "left").select("_src", (F.col("_filled") + F.coalesce("_used", zero)).alias("_filled")), "left"
    )
    placed = placed.withColumn("_at", F.lit(None).cast("long"))
    picks = stored(reduce(DataFrame.unionByName, picks), "picks")
    chosen = lookup_join(placed, picks.select("_src", "_key", "_picked_at"), ["_src", "_key"], "left", small=few)
    chosen = chosen.withColumn("_at", F.coalesce("_at", "_picked_at"))
    copies = F.col("_passes") + F.col("_at").isNotNull().cast("long")
    ends = left.select("_src", "_filled")
    chosen = lookup_join(chosen, ends, ["_src"], "inner", spread=["_key"], small=few)
    whole = F.col("_passes") * F.col("_source_size") + F.col("_filled")

    def place(epoch: Column) -> Column:
        start = F.when(epoch < F.col("_passes"), F.col("_before")).otherwise(F.col("_at"))
        asked = (epoch * F.col("_source_size") + start + F.col("_size") / 2) / F.greatest(whole, F.lit(1))
        out = F.lit(None).cast("double")
        for i, schedule in enumerate(curriculum):
            out = F.when(F.col("_number") % len(curriculum) == i, position_at(asked, schedule)).otherwise(out)
        return out

    epochs = F.when(F.col("_copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    return chosen.withColumn("_copies", copies).select(
        "_src",
        "_key",
        F.col("_one").alias("_size"),
        "_source_size",
        "_target",
        "_copies",
        F.transform(epochs, place).alias("_positions"),
    )


def mix_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """Every row of ``docs`` without its text, with its size, its source's figures, copies and positions."""
    base = without(docs, [c for c in RESULTS if c not in (text, doc_id, source)])
    inner = shielded(base, text, doc_id=doc_id, source=source)
    planned = stored(plan(inner.drop("_user"), **options), "plan")
    rows = _sized(inner, "text", "doc_id", "source").drop("text", "_size")
    return _with_plan(rows, planned).select(
        *unpacked([c for c in base.columns if c != text]),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_copies").alias("copies"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
        F.col("_positions").alias("positions"),
    )


def _with_plan(rows: DataFrame, planned: DataFrame) -> DataFrame:
    return lookup_join(rows, planned, ["_src", "_key"], "inner", small=None)


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The training sequence: rows of ``docs``, once per copy, range-sorted by training position."""
    inner = shielded(docs, text, doc_id=doc_id, source=source)
    planned = stored(plan(inner.drop("_user"), **options), "plan")
    rows = _sized(inner, "text", "doc_id", "source").drop("_size")
    taken = planned.where("_copies > 0").select("_src", "_key", "_positions")
    copies = _with_plan(rows, taken).withColumn("_position", F.explode("_positions"))
    order = [F.col("_position"), F.col("_src"), F.col("_key")]
    return copies.repartitionByRange(*order).sortWithinPartitions(*order).select(*restored(docs.columns, text))
