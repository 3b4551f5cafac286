"""The classification rules, one Column helper each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snarelight.model import LEGITIMATE, PHISHING, SUSPICIOUS

# Weights, thresholds and labels the results depend on.
RULE_WEIGHTS = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25}
RULE_SHARE, VOTE_SHARE = 0.6, 0.4
SCORE_LEVELS = ((0.75, "critical"), (0.5, "high"), (0.25, "medium"))
DECISIVE_VOTE, AGREEMENT_VOTE = 0.3, 0.5
AGREEMENT_LABELS = ("Phishing Agreement", "Legitimate Agreement", "Uncertain")
COMMUNITY_LABELS = (
    "Community Confirmed Phishing",
    "Community Confirmed Legitimate",
    "Under Community Review",
)
RESULT_CODES = (PHISHING, LEGITIMATE, SUSPICIOUS)


def by_average(avg_vote: Column, threshold: float, outcomes: tuple[str, str, str]) -> Column:
    """(above, below, otherwise); both comparisons are strict and NULL means otherwise."""
    above, below, between = outcomes
    return F.when(avg_vote > threshold, above).when(avg_vote < -threshold, below).otherwise(between)


def rule_weight(risk_level: Column) -> Column:
    return F.coalesce(
        *[F.when(risk_level == level, F.lit(weight)) for level, weight in RULE_WEIGHTS.items()], F.lit(0.0)
    )


def blended_score(avg_rule_weight: Column, avg_vote: Column) -> Column:
    return avg_rule_weight * RULE_SHARE + (avg_vote + 1) / 2 * VOTE_SHARE


def score_level(score: Column) -> Column:
    levels = [F.when(score >= floor, level) for floor, level in SCORE_LEVELS]
    return F.coalesce(*levels, F.lit("low"))


def code_from_match_count(matches: Column) -> Column:
    return F.when(matches >= 3, PHISHING).when(matches >= 1, SUSPICIOUS).otherwise(LEGITIMATE)


def rule_bucket(rules: Column) -> Column:
    return (
        F.when(rules >= 3, "High Risk")
        .when(rules == 2, "Medium Risk")
        .when(rules == 1, "Low Risk")
        .otherwise("No Rules Matched")
    )


def votes_contradict(code: Column, votes: Column, positive: Column, negative: Column) -> Column:
    """Some vote differs from the one the result code leads to expect.

    PHISHING expects +1, LEGITIMATE -1; any other code expects neither, so every vote differs.
    """
    agreeing = F.when(code == PHISHING, positive).when(code == LEGITIMATE, negative).otherwise(0)
    return votes > agreeing
