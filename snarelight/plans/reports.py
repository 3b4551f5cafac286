"""Read-only reports. Each takes the tables and returns a DataFrame.

Size checks, top rows and rankings run jobs while the report is being built, once each.

Ordered reports end in a range-partitioned sort, limited ones in a top-k; ties are broken
by the remaining key columns. Foreign keys are taken as given (``audit`` reports breaches).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snarelight.functions.text import like_any_case
from snarelight.functions.times import micros_between, moment
from snarelight.functions.verdicts import (
    AGREEMENT_LABELS,
    AGREEMENT_VOTE,
    by_average,
    rule_bucket,
    votes_contradict,
)
from snarelight.model import LEGITIMATE, PHISHING, SUSPICIOUS, Tables
from snarelight.operators import rollups
from snarelight.operators.positions import with_group_positions, with_rank
from snarelight.operators.skew import BROADCAST_ROWS, expand_join, lookup_join
from snarelight.operators.topk import rows_of, top_rows, with_people_and_votes
from snarelight.session import stored

# The top-level domains the category report lists.
LISTED_TLDS = (".tk", ".ml", ".ga")


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


# --- users ---------------------------------------------------------------------------


def users_by_role(tables: Tables) -> DataFrame:
    return tables.users.select("user_id", "name", "email", "role").orderBy("role", "name", "user_id")


def user_roles(tables: Tables) -> DataFrame:
    return tables.users.select("user_id", "name", "email", "role").orderBy("user_id")


def contributor_stats(tables: Tables, limit: int | None = 10) -> DataFrame:
    counts = ["total_submissions", "phishing_count", "legitimate_count", "suspicious_count"]
    stats = (
        tables.users.where(F.col("role") == "user")
        .select("user_id", "name", "email", "role")
        .join(rollups.code_counts("user_id", tables.url_submissions), "user_id", "left")
    )
    stats = rollups.zero_if_null(stats, *counts)
    return _limited(stats.orderBy(F.desc("total_submissions"), "user_id"), limit)


def top_rule_submitters(tables: Tables) -> DataFrame:
    per_user = (
        tables.url_submissions.select("url_id", "user_id")
        .join(rollups.matches_by_url(tables.url_rule_matches), "url_id")
        .groupBy("user_id")
        .agg(
            F.count("url_id").alias("urls_submitted"),
            F.sum("match_count").alias("total_rule_matches"),
            F.avg("match_count").alias("avg_rules_per_url"),
        )
    )
    return (
        tables.users.where(F.col("role") == "user")
        .select("user_id", "name", "email", "role")
        .join(per_user, "user_id")
        .orderBy(F.desc("total_rule_matches"), "user_id")
    )


# --- totals --------------------------------------------------------------------------


def result_counts(tables: Tables) -> DataFrame:
    return tables.url_submissions.groupBy("result_code").agg(F.count(F.lit(1)).alias("url_count"))


def dashboard_totals(tables: Tables) -> DataFrame:
    code = F.col("result_code")
    return tables.url_submissions.agg(
        F.count(F.lit(1)).alias("total_urls"),
        F.count_if(code == PHISHING).alias("phishing"),
        F.count_if(code == LEGITIMATE).alias("legitimate"),
        F.count_if(code == SUSPICIOUS).alias("suspicious"),
        F.count_if(code.isNull()).alias("unknown"),
    ).select(
        "*",
        tables.users.agg(F.count(F.lit(1))).scalar().alias("total_users"),
        tables.rules.agg(F.count(F.lit(1))).scalar().alias("total_rules"),
    )


def health_count(tables: Tables) -> DataFrame:
    return tables.url_submissions.agg(F.count(F.lit(1)).alias("url_count"))


def activity_counts(tables: Tables) -> DataFrame:
    """Remaining URLs and how many of them have a vote."""
    voted = rollups.keys_of(tables.votes).withColumn("voted", F.lit(True))
    return (
        tables.url_submissions.select("url_id")
        .join(voted, "url_id", "left")
        .agg(F.count("url_id").alias("remaining_urls"), F.count("voted").alias("urls_with_votes"))
    )


def feed_summary(tables: Tables, feed_email: str) -> DataFrame:
    """Count and newest row of the feed user's URLs; (0, NULL) when there is no feed user."""
    feed_user = tables.users.where(F.col("email") == feed_email).select("user_id")
    return (
        lookup_join(tables.url_submissions.select("user_id", "created_at"), feed_user, ["user_id"], "left_semi")
        .agg(F.count(F.lit(1)).alias("url_count"), F.max("created_at").alias("last_import"))
    )


# --- rules ---------------------------------------------------------------------------


def rule_catalog(tables: Tables) -> DataFrame:
    return tables.rules.select("rule_id", "rule_name", "rule_type", "risk_level").orderBy("rule_name")


def rule_usage(tables: Tables) -> DataFrame:
    used = tables.url_rule_matches.groupBy("rule_id").agg(F.count("url_id").alias("urls_matched"))
    usage = tables.rules.select("rule_id", "rule_name", "rule_type", "risk_level").join(used, "rule_id", "left")
    return rollups.zero_if_null(usage, "urls_matched").orderBy(F.desc("urls_matched"), "rule_name")


def rule_effectiveness(tables: Tables, limit: int | None = 25) -> DataFrame:
    """Distinct URLs each rule matched and how many of them turned out bad or good."""
    code = F.col("result_code")
    coded = (
        rollups.rules_by_url(tables.url_rule_matches)
        .join(tables.url_submissions.select("url_id", "result_code"), "url_id", "left")
        .select(F.explode("rule_ids").alias("rule_id"), "result_code")
        .groupBy("rule_id")
        .agg(
            F.count(F.lit(1)).alias("urls_matched"),
            F.count_if(code == PHISHING).alias("phishing_matches"),
            F.count_if(code == LEGITIMATE).alias("legitimate_matches"),
        )
    )
    share = F.col("phishing_matches").cast("double") / F.col("urls_matched") * 100
    return _limited(
        tables.rules.select("rule_id", "rule_name", "rule_type", "risk_level")
        .join(coded, "rule_id")
        .withColumn("phishing_accuracy_percent", F.round(share, 2))
        .orderBy(F.desc("urls_matched"), F.desc("phishing_accuracy_percent"), "rule_id"),
        limit,
    )


def rule_match_check(tables: Tables, rule_name: str) -> DataFrame:
    named = tables.rules.where(F.col("rule_name") == rule_name).select("rule_id", "rule_name")
    counted = (
        lookup_join(tables.url_rule_matches.select("match_id", "url_id", "rule_id"), named, ["rule_id"], "left_semi", ["match_id"])
        .groupBy("rule_id")
        .agg(F.count("url_id").alias("urls_matched"))
    )
    return rollups.zero_if_null(named.join(counted, "rule_id", "left"), "urls_matched")


def match_validity(tables: Tables) -> DataFrame:
    """All matches, and those whose URL and rule both exist."""
    matches = tables.url_rule_matches.groupBy("url_id", "rule_id").agg(F.count(F.lit(1)).alias("copies"))
    known_url = lookup_join(
        matches,
        tables.url_submissions.select("url_id", F.lit(True).alias("url_ok")),
        ["url_id"],
        "left",
        ["rule_id"],
        sizes_from=tables.url_rule_matches,
    )
    known = lookup_join(
        known_url,
        tables.rules.select("rule_id", F.lit(True).alias("rule_ok")),
        ["rule_id"],
        "left",
        ["url_id"],
        sizes_from=tables.url_rule_matches,
    )
    valid = F.when(F.col("url_ok") & F.col("rule_ok"), F.col("copies"))
    return known.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rule_matches"),
        F.coalesce(F.sum(valid), F.lit(0)).alias("valid_matches"),
    )


# --- submissions ---------------------------------------------------------------------


def phishing_urls(tables: Tables) -> DataFrame:
    return tables.url_submissions.where(F.col("result_code") == PHISHING).select("url", "result_code")


def vote_tally(tables: Tables) -> DataFrame:
    return rollups.votes_by_url(tables.votes).select("url_id", "phishing_votes", "legitimate_votes")


def vote_distribution(tables: Tables) -> DataFrame:
    split = tables.url_submissions.select("url_id", "url").join(vote_tally(tables), "url_id", "left")
    return rollups.zero_if_null(split, "phishing_votes", "legitimate_votes")


def url_listing(tables: Tables) -> DataFrame:
    """Every URL with its submitter and the names of its rules, newest first."""
    named = lookup_join(
        tables.url_rule_matches.select("match_id", "url_id", "rule_id"),
        tables.rules.select("rule_id", "rule_name"),
        ["rule_id"],
        "left",
        ["match_id"],
    )
    per_url = named.groupBy("url_id").agg(
        F.count("rule_id").alias("matched_rules_count"),
        F.expr("listagg(rule_name, ', ') within group (order by rule_name)").alias("matched_rule_names"),
    )
    people = tables.users.select(
        "user_id", F.col("name").alias("submitter_name"), F.col("email").alias("submitter_email")
    )
    listed = lookup_join(tables.url_submissions, people, ["user_id"], "inner", ["url_id"]).join(per_url, "url_id", "left")
    return (
        rollups.zero_if_null(listed, "matched_rules_count")
        .select(
            "url_id",
            "url",
            "url_domain",
            "tld",
            "result_code",
            "submitter_name",
            "submitter_email",
            "matched_rules_count",
            "matched_rule_names",
            "created_at",
            "updated_at",
        )
        .orderBy(F.desc("created_at"), F.desc("url_id"))
    )


def recent_urls(tables: Tables, limit: int = 5) -> DataFrame:
    """The newest URLs; submitters and votes are looked up for those few only."""
    order = [F.desc("created_at"), F.desc("url_id")]
    columns = ["url_id", "user_id", "url", "url_domain", "result_code", "created_at"]
    newest = top_rows(tables.url_submissions.select(*columns), order, limit)
    return (
        with_people_and_votes(tables, newest, limit)
        .select(*[c for c in columns if c != "user_id"], "submitter", "phishing_votes", "legitimate_votes")
        .orderBy(*order)
    )


def inserted_url_check(tables: Tables, url: str) -> DataFrame:
    """One URL, found by its text, with its number of matched rules."""
    found = tables.url_submissions.where(F.col("url") == url).select(
        "url_id", "url", "url_domain", "result_code", "created_at"
    )
    # The url is unique, so there is at most one row to send to the matches.
    counts = rollups.matches_by_url(
        tables.url_rule_matches.join(F.broadcast(found.select("url_id")), "url_id", "left_semi")
    ).withColumnRenamed("match_count", "rules_matched")
    return rollups.zero_if_null(found.join(counts, "url_id", "left"), "rules_matched")


def recently_updated(tables: Tables, as_of: datetime, limit: int = 5) -> DataFrame:
    since = moment(as_of, minutes=1)
    return (
        tables.url_submissions.where(F.col("updated_at") >= since)
        .select("url_id", "url", "result_code", "updated_at")
        .orderBy(F.desc("updated_at"), "url_id")
        .limit(limit)
    )


def tld_submission_rank(tables: Tables) -> DataFrame:
    """Newest-first place of each URL within its top-level domain, and the domain's size."""
    columns = ["url_id", "url", "url_domain", "tld", "result_code", "created_at"]
    return with_group_positions(
        tables.url_submissions.where(F.col("tld").isNotNull()).select(*columns),
        "tld",
        [F.desc("created_at"), F.desc("url_id")],
        "submission_rank_in_tld",
        "total_submissions_in_tld",
    ).select(*columns, "submission_rank_in_tld", "total_submissions_in_tld")


# --- reviews and votes ---------------------------------------------------------------


def vote_conflicts(tables: Tables, limit: int | None = 10) -> DataFrame:
    """Reviewed URLs with a vote that contradicts their result code.

    One row per (URL, label, description); votes count once per review with that text.
    """
    votes = rollups.votes_by_url(tables.votes).drop("avg_vote_value")
    contradicted = (
        tables.url_submissions.select("url_id", "url", "result_code")
        .join(votes, "url_id")
        .where(
            votes_contradict(
                F.col("result_code"), F.col("vote_count"), F.col("phishing_votes"), F.col("legitimate_votes")
            )
        )
    )
    reviews = tables.statuses.groupBy(
        "url_id", F.col("label").alias("review_status"), F.col("description").alias("review_description")
    ).agg(F.count(F.lit(1)).alias("reviews"))
    joined = lookup_join(
        reviews,
        contradicted,
        ["url_id"],
        "inner",
        ["review_status", "review_description"],
        small=False,
        sizes_from=tables.statuses,
    )
    times = F.col("reviews")
    return _limited(
        joined.select(
            "url_id",
            "url",
            "result_code",
            "review_status",
            "review_description",
            (F.col("phishing_votes") * times).alias("phishing_votes"),
            (F.col("legitimate_votes") * times).alias("legitimate_votes"),
            (F.col("vote_count") * times).alias("total_votes"),
        ).orderBy(
            F.desc("total_votes"),
            F.desc("url_id"),
            F.asc_nulls_first("review_status"),
            F.asc_nulls_first("review_description"),
        ),
        limit,
    )


def _url_scores(tables: Tables) -> DataFrame:
    """One row per (URL, external score, level); URLs without a score get 0.5."""
    groups = tables.url_score_comparisons.groupBy("url_id", "avg_score", "risk_level").agg(
        F.count(F.lit(1)).alias("score_rows")
    )
    unscored = tables.url_submissions.select("url_id").join(
        rollups.keys_of(tables.url_score_comparisons), "url_id", "left_anti"
    )
    return (
        groups.unionByName(unscored, allowMissingColumns=True)
        .withColumn("risk_score", F.coalesce("avg_score", F.lit(0.5)))
        .withColumn("score_rows", F.coalesce("score_rows", F.lit(1)))
    )


def risk_rankings(tables: Tables, limit: int | None = 20) -> DataFrame:
    """URLs ranked by external score with the voters' agreement.

    Only ids and scores are ranked; texts and votes are joined afterwards. Limited: the top
    rows are cut first, so the rank window sees only them (a rank inside a prefix of the
    order equals the global rank). Without a limit, or with a large one, ranks are running
    counts over the distinct scores.
    """
    scores = _url_scores(tables)
    urls = tables.url_submissions.select("url_id", "url", "url_domain", "result_code")
    if limit is None or limit > BROADCAST_ROWS:
        scores = stored(scores, "scores")  # narrow rows, read for the distinct scores, their ranks and the join
        ranked = with_rank(scores, "risk_score", "risk_rank")
        votes = rollups.votes_by_url(tables.votes).select("url_id", "vote_count", "avg_vote_value")
        described = lookup_join(
            ranked,
            urls.join(votes, "url_id", "left"),
            ["url_id"],
            "inner",
            ["avg_score", "risk_level"],
            small=False,
            sizes_from=tables.url_score_comparisons,
        )
    else:
        order = [
            F.desc("risk_score"),
            F.col("url_id").asc(),
            F.asc_nulls_first("risk_level"),
            F.asc_nulls_first("avg_score"),
        ]
        top = top_rows(scores, order, limit)
        ranked = top.withColumn("risk_rank", F.rank().over(W.orderBy(F.desc("risk_score"))).cast("bigint"))
        votes = rollups.votes_by_url(rows_of(tables.votes, top, "url_id", limit))
        described = ranked.join(rows_of(urls, top, "url_id", limit), "url_id").join(
            votes.select("url_id", "vote_count", "avg_vote_value"), "url_id", "left"
        )
    # One total order for both ways, so that a limit cuts tied rows alike.
    places = ["risk_rank", "url_id", F.asc_nulls_first("risk_level"), F.asc_nulls_first("avg_score")]
    described = _limited(described.orderBy(*places), limit)
    return described.select(
        "url_id",
        "url",
        "url_domain",
        "result_code",
        "risk_score",
        "risk_level",
        (F.coalesce("vote_count", F.lit(0)) * F.col("score_rows")).alias("vote_count"),
        "avg_vote_value",
        "risk_rank",
        by_average(F.col("avg_vote_value"), AGREEMENT_VOTE, AGREEMENT_LABELS).alias("agreement_status"),
    )


def url_analysis_report(tables: Tables) -> DataFrame:
    """Rules, voters and reviews of every URL that has a rule match or a vote."""
    rules = rollups.rules_by_url(tables.url_rule_matches).select(
        "url_id", F.size("rule_ids").cast("bigint").alias("rules_triggered")
    )
    voters = tables.votes.groupBy("url_id").agg(F.count_distinct("user_id").alias("voters_count"))
    report = (
        tables.url_submissions.select("url_id", "url", "url_domain", "tld", "result_code")
        .join(rules, "url_id", "left")
        .join(voters, "url_id", "left")
        .join(rollups.reviews_by_url(tables.statuses), "url_id", "left")
    )
    report = rollups.zero_if_null(report, "rules_triggered", "voters_count", "review_count").where(
        (F.col("rules_triggered") > 0) | (F.col("voters_count") > 0)
    )
    scores = tables.url_score_comparisons.select("url_id", "avg_score").distinct()
    return expand_join(
        report, scores, ["url_id"], ["avg_score"], small=False, sizes_from=tables.url_score_comparisons
    ).select(
        "url_id",
        "url",
        "url_domain",
        "tld",
        "result_code",
        "rules_triggered",
        "voters_count",
        "review_count",
        "last_review_date",
        rule_bucket(F.col("rules_triggered")).alias("risk_assessment"),
        F.coalesce("avg_score", F.lit(0.0)).alias("external_score"),
    )


def risk_categories(tables: Tables) -> DataFrame:
    """Phishing URLs with two or more severe rules, and URLs under or matched by listed TLDs."""
    rules = tables.rules.select(
        "rule_id",
        F.coalesce(F.col("risk_level").isin("high", "critical"), F.lit(False)).alias("severe"),
        F.coalesce(F.col("rule_type") == "tld", F.lit(False)).alias("tld_rule"),
    )
    per_url = (
        lookup_join(
            tables.url_rule_matches.select("match_id", "url_id", "rule_id"), rules, ["rule_id"], "inner", ["match_id"]
        )
        .groupBy("url_id")
        .agg(
            F.count("rule_id").alias("all_rules"),
            F.count_if("severe").alias("severe_rules"),
            F.count_if("tld_rule").alias("tld_rules"),
        )
    )
    counted = tables.url_submissions.select("url_id", "url", "url_domain", "tld", "result_code").join(per_url, "url_id")
    listed = F.coalesce(F.col("tld").isin(*LISTED_TLDS), F.lit(False))
    severe_count = F.when((F.col("result_code") == PHISHING) & (F.col("severe_rules") >= 2), F.col("severe_rules"))
    tld_count = F.when(listed, F.col("all_rules")).when(F.col("tld_rules") > 0, F.col("tld_rules"))
    # Both branches of the union come from one pass: a URL yields up to two category rows.
    return (
        counted.withColumn(
            "entry",
            F.explode(
                F.array(
                    F.struct(F.lit("High_Risk_Phishing").alias("category"), severe_count.alias("rule_count")),
                    F.struct(F.lit("Suspicious_TLD").alias("category"), tld_count.alias("rule_count")),
                )
            ),
        )
        .where(F.col("entry.rule_count").isNotNull())
        .select("entry.category", "url_id", "url", "url_domain", "result_code", "entry.rule_count")
        .orderBy("category", F.desc("rule_count"), "url_id")
    )


def review_timeline(tables: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    """Recent submissions with their reviews and the days from one to the other."""
    since = moment(as_of, days=days)
    recent = tables.url_submissions.where(F.col("created_at") >= since).select(
        "url_id", "url", "result_code", F.col("created_at").alias("submission_date")
    )
    reviews = tables.statuses.select(
        "url_id",
        "status_id",
        "reviewer_id",
        F.col("label").alias("status_label"),
        F.col("result_code").alias("review_result"),
        F.col("created_at").alias("review_date"),
    )
    reviewers = tables.users.select(
        F.col("user_id").alias("reviewer_id"),
        F.col("name").alias("reviewer_name"),
        F.col("role").alias("reviewer_role"),
    )
    history = expand_join(recent, reviews, ["url_id"], ["status_id"]).where(
        F.col("reviewer_id").isNotNull() | F.col("result_code").isNotNull()
    )
    micros = micros_between(F.col("submission_date"), F.col("review_date"))
    return (
        lookup_join(history, reviewers, ["reviewer_id"], "left", ["url_id", "status_id"], sizes_from=tables.statuses)
        .select(
            "url_id",
            "url",
            "result_code",
            "submission_date",
            "status_id",
            "status_label",
            "review_result",
            "reviewer_name",
            "reviewer_role",
            "review_date",
            (micros / F.lit(86_400_000_000.0)).alias("days_between_submission_and_review"),
        )
        .orderBy(F.desc("submission_date"), F.desc("review_date"), "url_id", "status_id")
    )


def status_text_search(tables: Tables, text: str, column: str = "description", limit: int = 5) -> DataFrame:
    return (
        tables.statuses.where(like_any_case(F.col(column), text))
        .select("status_id", "url_id", "label", "result_code", "description", "created_at")
        .orderBy(F.desc("created_at"), "status_id")
        .limit(limit)
        .drop("created_at")
    )


def top_scores(tables: Tables, limit: int = 5) -> DataFrame:
    return (
        tables.url_score_comparisons.select("rep_id", "url_id", "avg_score", "risk_level", "external_source")
        .orderBy(F.desc_nulls_last("avg_score"), "rep_id")
        .limit(limit)
        .drop("rep_id")
    )


def viewer_votes(tables: Tables, pairs: DataFrame) -> DataFrame:
    """The vote of each (url_id, user_id) pair asked for, NULL where there is none."""
    asked = pairs.select("url_id", "user_id").distinct()
    cast = tables.votes.select("url_id", "user_id", F.col("vote_value").alias("current_user_vote"))
    return asked.join(cast, ["url_id", "user_id"], "left")
