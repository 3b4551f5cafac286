"""Quality rules: a threshold table compiled into one projection of built-in expressions.

No shuffle and no user function: every metric comes from the row's own text, repeats within a
text included (its 3-word windows are sorted inside the row).

Null texts count as empty and are rejected, as texts without words are; empty tables give empty
results; repeated rows are judged alike; an input column with the name of a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snarelight.llm.common import SPACES, WORD, lowered, restored, shielded, without

#: Common function words of English, French, Spanish and German.
STOP_WORDS = (
    "the of and to a in is that it for on was with as be by this are at from "
    "de la le et les des en un du une est que pour dans qui au par sur pas avec "
    "el y los se del las por con para una no su es al lo "
    "der die und den von zu das mit sich für auf ist im nicht dem eine ein als"
).split()


@dataclass(frozen=True)
class Threshold:
    """Rejects a document whose ``part`` is outside low..high times its ``whole`` (None: a plain bound)."""

    name: str
    part: str
    whole: str | None = None
    low: float | None = None
    high: float | None = None


#: The rules every document must meet.
BASE_RULES = (
    Threshold("too_few_words", "n_words", low=50),
    Threshold("repeated_windows", "n_repeat_words", "n_words", high=0.5),
)
#: The method's own: length, symbol, stop-word and line ratios. Each bound leaves prose a wide margin.
RATIO_RULES = (
    Threshold("word_length", "word_chars", "n_words", low=2.0, high=12.0),
    Threshold("symbols", "n_symbols", "n_words", high=0.25),
    Threshold("exclamations", "n_exclaims", "n_words", high=0.5),
    Threshold("stop_words", "n_stop_words", "n_words", low=0.01),
    Threshold("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
)
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE_METRICS = ["n_exclaims", "n_stop_words", "n_lines"]
#: A column that keeps filters above the metrics: pushed below, they would compute each metric again.
ROW = "_row"
RESULTS = [*METRICS, *MORE_METRICS, "base_failed", "failed_rules", "kept"]


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with METRICS and MORE_METRICS, as longs."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = without(docs, RESULTS).withColumn("_words", F.regexp_extract_all(body, F.lit(WORD), F.lit(0)))
    df = df.withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: F.translate(x, SPACES, "") != ""))
    windows = F.transform(
        F.sequence(F.lit(1), F.size("_words") - 2),
        lambda i: F.struct(F.concat_ws(" ", F.slice("_words", i, 3)).alias("w"), i.alias("i")),
    )
    nothing = F.array().cast("array<struct<w:string,i:int>>")
    df = df.withColumn("_windows", F.when(F.size("_words") >= 3, F.sort_array(windows)).otherwise(nothing))

    def again(x: Column, k: Column) -> Column:
        same = lambda other: F.coalesce(other["w"] == x["w"], F.lit(False))
        return same(F.get("_windows", k - 1)) | same(F.get("_windows", k + 1))

    df = df.withColumn("_places", F.sort_array(F.transform(F.filter("_windows", again), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("_places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_places", k + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda total, n: total + n,
    )
    return df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate(body, SPACES, "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": covered.cast("long"),
            "n_exclaims": (F.length(body) - F.length(F.translate(body, "!", ""))).cast("long"),
            "n_stop_words": F.size(F.filter("_words", lambda w: lowered(w).isin(STOP_WORDS))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            ROW: F.monotonically_increasing_id(),
        }
    ).drop("_words", "_lines", "_windows", "_places")


def fails(rule: Threshold) -> Column:
    """The rule as a condition; a whole of 0 fails nothing."""
    part, whole = F.col(rule.part), F.col(rule.whole) if rule.whole else F.lit(1)
    out = F.lit(False)
    if rule.low is not None:
        out = out | (part < F.lit(rule.low) * whole)
    if rule.high is not None:
        out = out | (part > F.lit(rule.high) * whole)
    return out


def judge(
    docs: DataFrame, text: str = "text", base: tuple[Threshold, ...] = BASE_RULES, rules: tuple[Threshold, ...] = RATIO_RULES
) -> DataFrame:
    """``docs`` with their metrics, ``base_failed``, ``failed_rules`` (names) and ``kept``."""
    failed = F.array_compact(F.array(*[F.when(fails(r), F.lit(r.name)) for r in (*base, *rules)]))
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | fails(r)
    judged = metrics(docs, text).withColumn("failed_rules", failed).withColumn("base_failed", base_failed)
    return judged.withColumn("kept", F.size("failed_rules") == 0)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that every rule keeps, with all their columns."""
    judged = judge(shielded(docs, text), "text").where(F.col("kept") & (F.col(ROW) >= 0))
    return judged.select(*restored(docs.columns, text))
