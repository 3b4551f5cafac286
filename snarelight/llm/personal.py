"""Personal data by weak supervision, in DataFrame expressions only.

Candidates are the strict patterns' matches and those of wider ones (written-out mail addresses,
national phone numbers, card-like numbers, IPv6). Labelers vote on each candidate: the strict pattern
with its checks, a gazetteer (top-level domains, calling codes, issuer prefixes, reserved
addresses), cue words before it, and its edges. Expectation-maximisation over the counts of vote
patterns estimates each labeler's reliability for each kind, and a logistic span classifier is
fitted to the resulting probabilities. Wide candidates that it accepts are added to the strict
spans, which all stay.

Texts are read once; candidates are stored without them. Only vote pattern counts reach the driver:
at most kinds x 3^labelers x length classes.

Spans are (kind, start, end) in code points, end exclusive. Null and empty texts have none;
repeated rows are scanned and counted each; empty tables give empty results. Input columns with the
name of a result are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from snarelight.llm.common import lowered, stored, without

KINDS = ("email", "ip", "card", "phone")
RESULTS = ["base_spans", "spans"]
CONTEXT = 40
#: Probability from which a wide candidate is a span.
ACCEPT = 0.9
EM_ROUNDS, FIT_ROUNDS = 30, 25

#: Possessive forms of the strict patterns: the same matches, without backtracking over long runs.
#: A mail address starts where a run of its characters starts, or where the match before ended.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++"
    r"(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": STRICT["card"],
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {
    ("email", "strict"): lambda t: F.contains(t, F.lit("@")),
    ("ip", "strict"): lambda t: t.rlike(r"[0-9]\.[0-9]"),
    ("card", "strict"): lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    ("phone", "strict"): lambda t: F.contains(t, F.lit("+")),
    ("email", "wide"): lambda t: F.contains(t, F.lit(" dot ")) | F.contains(t, F.lit("(dot)")) | F.contains(t, F.lit("[dot]")),
    ("ip", "wide"): lambda t: t.rlike(r":[0-9A-Fa-f]{1,4}:"),
    ("card", "wide"): lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    ("phone", "wide"): lambda t: t.rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"),
}
#: Gazetteers.
KNOWN = {
    "email": r"(?i)(?:\.|dot\W+)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|at|ch|be|pl|ru|br|mx|ar|us|ca|au|jp|cn|in)$",
    "ip": r"^(?!0|10\.|127\.|169\.254\.|192\.168\.|2(?:2[4-9]|[3-5][0-9])\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6[0245])",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
}
CUES = {
    "email": r"mail|contact|write to|reply",
    "ip": r"\bip\b|host|server|address|login from",
    "card": r"card|visa|master|amex|credit|karte|carte|tarjeta",
    "phone": r"phone|call|tel|mobile|fax|ring",
}
AGAINST = {
    "email": r"example|version",
    "ip": r"version|release|\bv$|section",
    "card": r"order|invoice|serial|isbn|number of|tracking",
    "phone": r"order|invoice|serial|isbn|part",
}


def _found(text: Column, pattern: str, needed: Column) -> Column:
    """Matches from left to right: array of (start, end, match, before, after), places in code points."""
    # The pieces around the matches give their places: both come from the same scan by the same pattern.
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    kind = "array<struct<start:int,end:int,match:string,before:string,after:string>>"

    def placed(around: Column) -> Column:
        return F.aggregate(
            around,
            F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["piece"]) + F.length(x["match"])).alias("at"),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(x["piece"])).alias("start"),
                            (acc["at"] + F.length(x["piece"]) + F.length(x["match"])).alias("end"),
                            x["match"].alias("match"),
                            F.right(x["piece"], F.lit(CONTEXT)).alias("before"),
                            F.left(x["next"], F.lit(1)).alias("after"),
                        )
                    ),
                ).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    # One row's pieces are bound once, so that they aren't made again for every match.
    bound = F.transform(
        F.array(F.struct(matches.alias("m"), pieces.alias("p"))),
        lambda z: placed(
            F.transform(
                z["m"],
                lambda m, i: F.struct(F.get(z["p"], i).alias("piece"), m.alias("match"), F.get(z["p"], i + 1).alias("next")),
            )
        ),
    )
    return F.when(needed, F.get(bound, F.lit(0))).otherwise(F.array().cast(kind))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    letters = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    values = F.transform(
        letters, lambda c, i: F.when(i % 2 == 0, c).otherwise(F.translate(c, "0123456789", "0246813579")).cast("int")
    )
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _is_valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        n = F.length(_digits(match))
        return F.when((n >= 13) & (n <= 19), passes_luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        n = F.length(_digits(match))
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _is_candidate(kind: str, match: Column) -> Column:
    if kind == "card":
        n = F.length(_digits(match))
        return (n >= 13) & (n <= 19)
    return F.lit(True)


def _voted(kind: str, strict: bool, x: Column) -> Column:
    """A candidate with its labelers' votes: 1 for, -1 against, 0 none."""
    for_, against = lowered(x["before"]).rlike(CUES[kind]), lowered(x["before"]).rlike(AGAINST[kind])
    edge = F.right(x["before"], F.lit(1)).rlike(r"[\p{L}\p{Nd}]") | x["after"].rlike(r"[\p{L}\p{Nd}]")
    known = x["match"].rlike(KNOWN[kind])
    return F.struct(
        F.lit(kind).alias("kind"),
        x["start"].alias("start"),
        x["end"].alias("end"),
        F.lit(1 if strict else 0).alias("pattern"),
        F.when(known, F.lit(1)).otherwise(F.lit(-1)).alias("gazetteer"),
        F.when(for_ & ~against, F.lit(1)).when(against & ~for_, F.lit(-1)).otherwise(F.lit(0)).alias("context"),
        F.when(edge, F.lit(-1)).otherwise(F.lit(1)).alias("edges"),
        F.least(F.floor((x["end"] - x["start"]) / 8), F.lit(3)).cast("int").alias("length"),
    )


LABELERS = ("pattern", "gazetteer", "context", "edges")
_VOTED = "array<struct<kind:string,start:int,end:int,pattern:int,gazetteer:int,context:int,edges:int,length:int>>"


def candidates(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with ``_strict`` and ``_wide``: arrays of voted candidates, by kind and start.

    Wide candidates that meet a strict span of any kind are left out.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], body.alias("_body"))
    for kind in KINDS:
        rows = rows.withColumn(f"_s_{kind}", _found(F.col("_body"), STRICT[kind], NEEDS[kind, "strict"](F.col("_body"))))
        rows = rows.withColumn(f"_w_{kind}", _found(F.col("_body"), WIDE[kind], NEEDS[kind, "wide"](F.col("_body"))))
    strict = [F.transform(_valid_of(k), _voter(k, True)) for k in KINDS]
    rows = rows.drop("_body").withColumn("_strict", F.concat(*strict).cast(_VOTED))
    wide = [F.transform(_free_of(k), _voter(k, False)) for k in KINDS]
    return rows.select(*[F.col(f"`{c}`") for c in keep], "_strict", F.concat(*wide).cast(_VOTED).alias("_wide"))


def _voter(kind: str, strict: bool):
    return lambda x: _voted(kind, strict, x)


def _valid_of(kind: str) -> Column:
    return F.filter(f"_s_{kind}", lambda x: _is_valid(kind, x["match"]))


def _free_of(kind: str) -> Column:
    return F.filter(
        f"_w_{kind}",
        lambda x: _is_candidate(kind, x["match"])
        & ~F.exists("_strict", lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])),
    )


@dataclass(frozen=True)
class Model:
    """Per kind: an intercept and weights of the features (labeler, vote) and (length class)."""

    weights: dict[str, dict[str, float]]
    #: Per kind and labeler: the chance of a vote for, given a span and given none.
    reliability: dict[tuple[str, str], tuple[float, float]]


def _features(row: Row | dict) -> list[str]:
    return ["bias", *[f"{name}:{row[name]}" for name in LABELERS if row[name]], f"length:{row['length']}"]


def estimate(counts: list[Row]) -> dict[str, dict]:
    """Of one kind: the probability of a span per vote pattern, and the labelers' tables.

    Labelers are taken as independent given the truth. The start trusts the strict pattern, and the
    others by majority, which also tells which class is which.
    """
    belief = {}
    for i, row in enumerate(counts):
        votes = sum(row[name] for name in LABELERS[1:])
        belief[i] = 0.95 if row["pattern"] > 0 else 0.7 if votes >= 2 else 0.2 if votes >= 0 else 0.05
    tables: dict = {}
    for _ in range(EM_ROUNDS):
        total = sum(row["n"] for row in counts)
        prior = (sum(belief[i] * row["n"] for i, row in enumerate(counts)) + 1) / (total + 2)
        for name in LABELERS:
            for vote in (-1, 0, 1):
                hit = [(i, row["n"]) for i, row in enumerate(counts) if row[name] == vote]
                yes = sum(belief[i] * n for i, n in hit) + 1
                no = sum((1 - belief[i]) * n for i, n in hit) + 1
                tables[name, vote] = (yes / (prior * (total + 2) + 3), no / ((1 - prior) * (total + 2) + 3))
        for i, row in enumerate(counts):
            log = math.log(prior / (1 - prior)) + sum(
                math.log(tables[name, row[name]][0] / tables[name, row[name]][1]) for name in LABELERS
            )
            belief[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))
    return {"belief": belief, "tables": tables}


def fit(counts: list[Row], belief: dict[int, float]) -> dict[str, float]:
    """Logistic weights for one kind, by coordinate Newton steps on the pattern counts with a ridge of 1."""
    names = sorted({f for row in counts for f in _features(row)})
    weights = dict.fromkeys(names, 0.0)
    rows = [(_features(row), row["n"], belief[i]) for i, row in enumerate(counts)]
    for _ in range(FIT_ROUNDS):
        for name in names:
            slope, bend = -weights[name], 1.0
            for features, n, target in rows:
                if name in features:
                    p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[f] for f in features)))))
                    slope += n * (target - p)
                    bend += n * p * (1 - p)
            weights[name] += max(-2.0, min(2.0, slope / bend))
    return weights


def train(found: DataFrame) -> Model:
    """Fits the model to all candidates; the driver sees the counts of vote patterns only."""
    every = found.select(F.explode(F.concat("_strict", "_wide")).alias("c")).select("c.*")
    rows = every.groupBy("kind", *LABELERS, "length").agg(F.count(F.lit(1)).alias("n")).collect()
    weights, reliability = {}, {}
    for kind in KINDS:
        own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: tuple(r[:-1]))
        if own:
            got = estimate(own)
            weights[kind] = fit(own, got["belief"])
            reliability |= {(kind, name): got["tables"][name, 1] for name in LABELERS}
    return Model(weights, reliability)


def accepted(model: Model, x: Column) -> Column:
    """Whether the classifier takes candidate ``x`` for a span."""
    out = F.lit(False)
    for kind, weights in model.weights.items():
        score = F.lit(weights.get("bias", 0.0))
        for name, weight in weights.items():
            if name != "bias":
                feature, _, value = name.partition(":")
                score = score + F.when(x[feature] == int(value), F.lit(weight)).otherwise(F.lit(0.0))
        out = F.when(x["kind"] == kind, score >= F.lit(math.log(ACCEPT / (1 - ACCEPT)))).otherwise(out)
    return out


def find_spans(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all but the text) with base_spans and spans, by kind and start."""
    kept = [c for c in without(docs, RESULTS).columns if c != text] if keep is None else keep
    found = stored(candidates(docs, text, kept), "candidates")
    model = train(found)
    bare = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    more = F.filter("_wide", lambda x: accepted(model, x))
    everything = F.concat(F.transform("_strict", bare), F.transform(more, bare))
    by_kind = [F.array_sort(F.filter(everything, _of(k))) for k in KINDS]
    return found.select(*[F.col(f"`{c}`") for c in kept], F.transform("_strict", bare).alias("base_spans"), F.concat(*by_kind).alias("spans"))


def _of(kind: str):
    return lambda x: x["kind"] == kind
