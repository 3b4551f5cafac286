"""Set-oriented maintenance jobs: tables in, new tables out.

``affected`` counts the rows a job selects, changed or not. Nothing is written here;
``sources.snapshots`` stores the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snarelight.functions.times import moment
from snarelight.functions.verdicts import (
    AGREEMENT_VOTE,
    COMMUNITY_LABELS,
    DECISIVE_VOTE,
    RESULT_CODES,
    blended_score,
    by_average,
    code_from_match_count,
    score_level,
)
from snarelight.model import LEGITIMATE, SCHEMAS, Tables
from snarelight.operators import rollups
from snarelight.operators.positions import with_new_ids
from snarelight.operators.skew import lookup_join

# Thresholds of the jobs and the texts they write.
MIN_DECISIVE_VOTES = 3
MIN_COMMUNITY_VOTES = 2
PROMOTE_SUBMISSIONS, PROMOTE_PHISHING = 10, 5
ADMIN_NOTE = " | Updated by system based on agreement threshold"


@dataclass(frozen=True)
class Change:
    """New tables, the keys of the rows a job selected, and rows it could not change."""

    tables: Tables
    affected: DataFrame
    problems: DataFrame | None = None

    def rows_affected(self) -> int:
        return self.affected.count()


def shaped(df: DataFrame, table: str) -> DataFrame:
    """The declared columns of a table, in order and with their types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[table]])


def reclassify_by_votes(tables: Tables, as_of: datetime) -> Change:
    decisive = (
        rollups.votes_by_url(tables.votes)
        .where((F.col("vote_count") >= MIN_DECISIVE_VOTES) & (F.abs("avg_vote_value") > DECISIVE_VOTE))
        .select("url_id", by_average(F.col("avg_vote_value"), DECISIVE_VOTE, RESULT_CODES).alias("voted_code"))
    )
    joined = tables.url_submissions.join(decisive, "url_id", "left")
    voted = F.col("voted_code")
    changed = joined.withColumn("result_code", F.coalesce(voted, F.col("result_code"))).withColumn(
        "updated_at", F.when(voted.isNotNull(), moment(as_of)).otherwise(F.col("updated_at"))
    )
    return Change(
        tables.with_tables(url_submissions=shaped(changed, "url_submissions")),
        joined.where(voted.isNotNull()).select("url_id"),
    )


def recompute_scores(tables: Tables) -> Change:
    """Overwrites every score row with 0.6 x mean rule weight + 0.4 x mean vote scaled to 0..1."""
    votes = rollups.votes_by_url(tables.votes).select("url_id", "avg_vote_value")
    metrics = (
        tables.url_submissions.select("url_id")
        .join(rollups.rule_weight_by_url(tables), "url_id", "left")
        .join(votes, "url_id", "left")
        .select(
            "url_id",
            blended_score(F.coalesce("avg_rule_weight", F.lit(0.0)), F.col("avg_vote_value")).alias("new_score"),
            F.lit(True).alias("known"),
        )
    )
    joined = lookup_join(tables.url_score_comparisons, metrics, ["url_id"], "left", ["rep_id"], small=False)
    known = F.col("known").isNotNull()
    changed = joined.withColumn(
        "avg_score", F.when(known, F.col("new_score")).otherwise(F.col("avg_score"))
    ).withColumn("risk_level", F.when(known, score_level(F.col("new_score"))).otherwise(F.col("risk_level")))
    return Change(
        tables.with_tables(url_score_comparisons=shaped(changed, "url_score_comparisons")),
        joined.where(known).select("rep_id"),
    )


def cleanup_inactive(tables: Tables, as_of: datetime, days: int = 90) -> Change:
    """Drops old URLs without votes, statuses or matches, and their scores."""
    sources = [tables.votes, tables.statuses, tables.url_rule_matches]
    active = rollups.keys_of(reduce(DataFrame.union, [t.select("url_id") for t in sources]))
    flagged = tables.url_submissions.join(active.withColumn("active", F.lit(True)), "url_id", "left")
    idle = F.col("active").isNull() & (F.col("created_at") < moment(as_of, days=days))
    removed = flagged.where(idle).select("url_id")
    scores = lookup_join(tables.url_score_comparisons, removed, ["url_id"], "left_anti", ["rep_id"], small=False)
    return Change(
        tables.remembering("url_submissions", "url_score_comparisons").with_tables(
            url_submissions=shaped(flagged.where(~idle), "url_submissions"),
            url_score_comparisons=shaped(scores, "url_score_comparisons"),
        ),
        removed,
    )


def cleanup_rule_matches(tables: Tables) -> Change:
    """Drops matches whose URL or rule is gone, and severe rules on legitimate URLs."""
    urls = tables.url_submissions.select(
        "url_id", (F.col("result_code") == LEGITIMATE).alias("benign"), F.lit(True).alias("url_ok")
    )
    rules = tables.rules.select(
        "rule_id", F.col("risk_level").isin("high", "critical").alias("severe"), F.lit(True).alias("rule_ok")
    )
    joined = lookup_join(tables.url_rule_matches, rules, ["rule_id"], "left", ["match_id"])
    joined = lookup_join(joined, urls, ["url_id"], "left", ["match_id"], sizes_from=tables.url_rule_matches)
    drop = F.col("url_ok").isNull() | F.col("rule_ok").isNull() | F.coalesce(
        F.col("benign") & F.col("severe"), F.lit(False)
    )
    return Change(
        tables.remembering("url_rule_matches").with_tables(url_rule_matches=shaped(joined.where(~drop), "url_rule_matches")),
        joined.where(drop).select("match_id"),
    )


def promote_users(tables: Tables) -> Change:
    counts = rollups.code_counts("user_id", tables.url_submissions).select(
        "user_id", "total_submissions", "phishing_count"
    )
    joined = tables.users.join(counts, "user_id", "left")
    prolific = F.coalesce(F.col("total_submissions") >= PROMOTE_SUBMISSIONS, F.lit(False))
    earned = prolific & (F.col("phishing_count") >= PROMOTE_PHISHING) & (F.col("role") == "user")
    changed = joined.withColumn("role", F.when(earned, "analyst").otherwise(F.col("role")))
    return Change(
        tables.with_tables(users=shaped(changed, "users")), joined.where(prolific).select("user_id")
    )


def auto_classify(tables: Tables, as_of: datetime, strict: bool = False) -> Change:
    """Classifies pending URLs by their number of matches.

    Strict mode leaves URLs without matches pending and does not touch ``updated_at``.
    """
    joined = tables.url_submissions.join(rollups.matches_by_url(tables.url_rule_matches), "url_id", "left")
    pending = F.col("result_code").isNull()
    code = code_from_match_count(F.coalesce("match_count", F.lit(0)))
    if strict:
        code = F.when(F.col("match_count").isNotNull(), code)
    changed = joined.withColumn(
        "updated_at", F.when(pending & F.lit(not strict), moment(as_of)).otherwise(F.col("updated_at"))
    ).withColumn("result_code", F.when(pending, code).otherwise(F.col("result_code")))
    return Change(
        tables.with_tables(url_submissions=shaped(changed, "url_submissions")),
        tables.url_submissions.where(pending).select("url_id"),
    )


def annotate_admin_statuses(tables: Tables) -> Change:
    """Adds a note to reviews by admins on voted URLs and copies the URL's result code.

    A status must have a code: where the URL has none the old one stays and the row is
    listed under ``problems``.
    """
    voted = rollups.votes_by_url(tables.votes).where(F.col("vote_count") >= MIN_COMMUNITY_VOTES).select("url_id")
    targets = (
        tables.url_submissions.select("url_id", F.col("result_code").alias("url_code"))
        .join(voted, "url_id", "left_semi")
        .withColumn("voted", F.lit(True))
    )
    admins = tables.users.where(F.col("role") == "admin").select(
        F.col("user_id").alias("reviewer_id"), F.lit(True).alias("by_admin")
    )
    joined = lookup_join(tables.statuses, admins, ["reviewer_id"], "left", ["status_id"])
    joined = lookup_join(
        joined, targets, ["url_id"], "left", ["status_id"], small=False, sizes_from=tables.statuses
    )
    chosen = F.coalesce(F.col("voted") & F.col("by_admin"), F.lit(False))
    changed = joined.withColumn(
        "description",
        F.when(chosen, F.concat("description", F.lit(ADMIN_NOTE))).otherwise(F.col("description")),
    ).withColumn("result_code", F.when(chosen, F.coalesce("url_code", "result_code")).otherwise(F.col("result_code")))
    picked = joined.where(chosen)
    return Change(
        tables.with_tables(statuses=shaped(changed, "statuses")),
        picked.select("status_id"),
        picked.where(F.col("url_code").isNull()).select("status_id", "url_id"),
    )


def new_community_statuses(tables: Tables, as_of: datetime, days: int = 1) -> DataFrame:
    """Status rows (without ids) for voted URLs that had no review lately."""
    recent = rollups.keys_of(tables.statuses.where(F.col("created_at") > moment(as_of, days=days)))
    avg = F.col("avg_vote_value")
    reviewer = tables.users.where(F.col("role") == "admin").agg(F.min("user_id")).scalar()
    return (
        rollups.votes_by_url(tables.votes)
        .where(F.col("vote_count") >= MIN_COMMUNITY_VOTES)
        .join(recent, "url_id", "left_anti")
        .select(
            "url_id",
            reviewer.alias("reviewer_id"),
            by_average(avg, AGREEMENT_VOTE, RESULT_CODES).alias("result_code"),
            by_average(avg, AGREEMENT_VOTE, COMMUNITY_LABELS).alias("label"),
            F.concat(
                F.lit("Automated status update based on "),
                F.col("vote_count").cast("string"),
                F.lit(" community votes. Average vote: "),
                F.round(avg, 2).cast("string"),
            ).alias("description"),
            moment(as_of).alias("created_at"),
        )
    )


def community_statuses(tables: Tables, as_of: datetime, days: int = 1, last_id: int | None = None) -> Change:
    added = with_new_ids(
        new_community_statuses(tables, as_of, days),
        [F.col("url_id").asc()],
        "status_id",
        tables.last_id("statuses") if last_id is None else last_id,
    )
    return Change(
        tables.with_tables(statuses=tables.statuses.unionByName(shaped(added, "statuses"))),
        added.select("status_id"),
    )
