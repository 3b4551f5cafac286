"""Per-key rollups shared by the reports and jobs.

Each is one partial-then-final aggregation, so a key with very many rows is combined
before the shuffle, and each yields one row per key, so the joins that follow are
one-to-one on ``url_id`` and cannot be skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snarelight.model import LEGITIMATE, PHISHING, SUSPICIOUS, Tables
from snarelight.operators.skew import lookup_join
from snarelight.functions.verdicts import rule_weight


def votes_by_url(votes: DataFrame) -> DataFrame:
    value = F.col("vote_value")
    return votes.groupBy("url_id").agg(
        F.count("vote_id").alias("vote_count"),
        F.count_if(value == 1).alias("phishing_votes"),
        F.count_if(value == -1).alias("legitimate_votes"),
        F.avg(value).alias("avg_vote_value"),
    )


def matches_by_url(matches: DataFrame) -> DataFrame:
    return matches.groupBy("url_id").agg(F.count("rule_id").alias("match_count"))


def rules_by_url(matches: DataFrame) -> DataFrame:
    """The distinct rules of each URL; the set cannot outgrow the rule catalogue."""
    return matches.groupBy("url_id").agg(F.collect_set("rule_id").alias("rule_ids"))


def reviews_by_url(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("url_id").agg(
        F.count("status_id").alias("review_count"), F.max("created_at").alias("last_review_date")
    )


def rule_weight_by_url(tables: Tables) -> DataFrame:
    weighted = lookup_join(
        tables.url_rule_matches.select("match_id", "url_id", "rule_id"),
        tables.rules.select("rule_id", rule_weight(F.col("risk_level")).alias("weight")),
        ["rule_id"],
        "left",
        spread=["match_id"],
    )
    return weighted.groupBy("url_id").agg(F.avg(F.coalesce("weight", F.lit(0.0))).alias("avg_rule_weight"))


def code_counts(by: str, submissions: DataFrame) -> DataFrame:
    code = F.col("result_code")
    return submissions.groupBy(by).agg(
        F.count("url_id").alias("total_submissions"),
        F.count_if(code == PHISHING).alias("phishing_count"),
        F.count_if(code == LEGITIMATE).alias("legitimate_count"),
        F.count_if(code == SUSPICIOUS).alias("suspicious_count"),
    )


def keys_of(df: DataFrame, key: str = "url_id") -> DataFrame:
    """Distinct keys, for EXISTS and NOT EXISTS."""
    return df.select(key).distinct()


def zero_if_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.fillna(0, subset=list(columns))
