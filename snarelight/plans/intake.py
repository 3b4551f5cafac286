"""Batch intake: requests in, accepted rows and rejected rows with reasons out.

Every request row needs a unique ``seq``; it decides which of several equal requests
comes first. File and partition order are never relied on.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snarelight.functions.text import blank_to_null, like_any_case, strip
from snarelight.functions.times import moment
from snarelight.functions.urls import malformed_host, url_scheme, with_url_parts
from snarelight.model import SUSPICIOUS, Tables
from snarelight.operators import rollups
from snarelight.operators.catalogue import with_catalogue
from snarelight.operators.positions import with_new_ids
from snarelight.operators.skew import dealt, is_small, lookup_join, parts_for
from snarelight.plans.maintenance import Change, shaped
from snarelight.session import stored

# Limits of the input forms.
MAX_URL, MAX_NOTE, MAX_EMAIL, MIN_NAME = 2048, 500, 255, 2
FORBIDDEN_IN_URL = r"[\n\r;]"
#: Matches and requests that one task of a removal sorts.
TASK_ROWS = 1_000_000


@dataclass(frozen=True)
class Intake:
    accepted: DataFrame
    rejected: DataFrame

    def labelled(self) -> DataFrame:
        """All requests with a ``reason``, NULL where accepted."""
        return self.accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(
            self.rejected, allowMissingColumns=True
        )


def _reason(checks: list[tuple[str, Column]]) -> Column:
    """The first check that fails."""
    return F.coalesce(*[F.when(failed, F.lit(name)) for name, failed in checks])


def _split(checked: DataFrame, first: DataFrame, repeat_reason: str) -> Intake:
    """``checked`` has a reason or NULL; ``first`` holds the seqs that may be stored."""
    marked = checked.join(first.select("seq", F.lit(True).alias("_ok")), "seq", "left").withColumn(
        "reason", F.coalesce("reason", F.when(F.col("_ok").isNull(), F.lit(repeat_reason)))
    )
    marked = marked.drop("_ok")
    return Intake(marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull()))


def checked_urls(requests: DataFrame) -> DataFrame:
    """Requests (seq, user_id, url, result_code) with URL parts and the checks on the row itself.

    Plain projections, so streams use them too.
    """
    url = F.col("url")
    rows = requests.withColumn("url", strip(F.coalesce(url, F.lit(""))))
    reason = _reason(
        [
            ("url_required", url == ""),
            ("invalid_characters", (F.length(url) > MAX_URL) | url.rlike(FORBIDDEN_IN_URL)),
            ("not_signed_in", F.coalesce(F.col("user_id"), F.lit(0)) == 0),
            ("malformed_host", malformed_host(url)),
        ]
    )
    return (
        with_url_parts(rows)
        .withColumn("scheme", url_scheme(url))
        .withColumn("url_length", F.length(url))
        .withColumn("result_code", F.coalesce(blank_to_null(F.col("result_code")), F.lit(SUSPICIOUS)))
        .withColumn("reason", reason)
    )


def submit_urls(tables: Tables, requests: DataFrame) -> Intake:
    """Validates and parses URL submissions; the first request for a new URL wins."""
    known = tables.users.select("user_id", F.lit(True).alias("_user"))
    rows = lookup_join(checked_urls(requests), known, ["user_id"], "left", ["seq"])
    rows = rows.withColumn(
        "reason", F.coalesce("reason", F.when(F.col("_user").isNull(), F.lit("unknown_user")))
    ).drop("_user")
    rows = stored(rows, "checked")  # read twice: for the first of each URL, and to mark the others
    first = (
        rows.where(F.col("reason").isNull())
        .groupBy("url")
        .agg(F.min("seq").alias("seq"))
        .join(tables.url_submissions.select("url"), "url", "left_anti")
    )
    return _split(rows, first, "duplicate_url")


def store_submissions(tables: Tables, accepted: DataFrame, as_of: datetime, last_id: int | None = None) -> Change:
    if last_id is None:
        last_id = tables.last_id("url_submissions")
    added = (
        with_new_ids(accepted, [F.col("seq").asc()], "url_id", last_id)
        .withColumn("created_at", moment(as_of))
        .withColumn("updated_at", F.lit(None))
    )
    added = shaped(added, "url_submissions")
    return Change(
        tables.with_tables(url_submissions=tables.url_submissions.unionByName(added)), added.select("url_id")
    )


def register_users(tables: Tables, requests: DataFrame) -> Intake:
    """Validates accounts (seq, name, email). Emails are unique as written.

    ``case_variant`` marks accepted emails that differ from another account only in case.
    """
    name, email = F.col("name"), F.col("email")
    rows = requests.withColumn("name", strip(F.coalesce(name, F.lit("")))).withColumn(
        "email", strip(F.coalesce(email, F.lit("")))
    )
    rows = rows.withColumn(
        "reason",
        _reason(
            [
                ("name_too_short", F.length(name) < MIN_NAME),
                ("invalid_email", ~email.contains("@") | (F.length(email) > MAX_EMAIL)),
            ]
        ),
    )
    rows = stored(rows, "checked")
    first = (
        rows.where(F.col("reason").isNull())
        .groupBy("email")
        .agg(F.min("seq").alias("seq"))
        .join(tables.users.select("email"), "email", "left_anti")
    )
    intake = _split(rows, first, "email_taken")
    folded = F.lower("email").alias("folded")
    shared = (
        tables.users.select(folded)
        .unionByName(intake.accepted.select(folded))
        .groupBy("folded")
        .agg((F.count(F.lit(1)) > 1).alias("case_variant"))
    )
    accepted = lookup_join(
        intake.accepted.withColumn("folded", F.lower("email")),
        shared,
        ["folded"],
        "left",
        ["seq"],
        small=False,
        sizes_from=rows.select(folded),
    )
    return Intake(accepted.drop("folded").withColumn("role", F.lit("user")), intake.rejected)


def add_rule_matches(tables: Tables, requests: DataFrame) -> Intake:
    """Checks hand-made matches (seq, url_id, rule_id, match_details)."""
    note = F.substring(strip(F.coalesce("match_details", F.lit(""))), 1, MAX_NOTE)
    rows = requests.withColumn("match_details", blank_to_null(note))
    urls = tables.url_submissions.select("url_id", F.lit(True).alias("_url"))
    rules = tables.rules.select("rule_id", F.lit(True).alias("_rule"))
    rows = lookup_join(rows, urls, ["url_id"], "left", ["seq"])
    rows = lookup_join(rows, rules, ["rule_id"], "left", ["seq"], sizes_from=requests)
    rows = rows.withColumn(
        "reason", _reason([("unknown_url", F.col("_url").isNull()), ("unknown_rule", F.col("_rule").isNull())])
    ).drop("_url", "_rule")
    rows = stored(rows, "checked")
    first = (
        rows.where(F.col("reason").isNull())
        .groupBy("url_id", "rule_id")
        .agg(F.min("seq").alias("seq"))
        .join(tables.url_rule_matches.select("url_id", "rule_id"), ["url_id", "rule_id"], "left_anti")
    )
    return _split(rows, first, "already_applied")


def store_matches(
    tables: Tables, accepted: DataFrame, as_of: datetime, order: list[str] = ["url_id", "rule_id"], last_id: int | None = None
) -> Change:
    if last_id is None:
        last_id = tables.last_id("url_rule_matches")
    added = with_new_ids(accepted, [F.col(c).asc() for c in order], "match_id", last_id)
    added = shaped(added.withColumn("matched_at", moment(as_of)), "url_rule_matches")
    return Change(
        tables.with_tables(url_rule_matches=tables.url_rule_matches.unionByName(added)), added.select("match_id")
    )


def remove_rule_matches(tables: Tables, requests: DataFrame, task_rows: int = TASK_ROWS) -> Change:
    """Deletes matches by (match_id, url_id); ``problems`` lists the pairs that do not exist.

    Both sides of the joins are dealt by the pair to tasks of about ``task_rows`` rows.
    """
    keys = ["match_id", "url_id"]
    asked = requests.select(*keys).distinct()
    parts = parts_for(tables.url_rule_matches, requests, task_rows=task_rows)
    matches, asked = (dealt(df, keys, parts) for df in (tables.url_rule_matches, asked))
    return Change(
        tables.remembering("url_rule_matches").with_tables(
            url_rule_matches=shaped(matches.join(asked, keys, "left_anti"), "url_rule_matches")
        ),
        matches.join(asked, keys, "left_semi").select("match_id"),
        asked.join(matches.select(*keys), keys, "left_anti"),
    )


def _ids(df: DataFrame | None, key: str, like: DataFrame) -> DataFrame:
    return (like.where(F.lit(False)) if df is None else df).select(key).distinct()


def delete_submissions(
    tables: Tables,
    url_ids: DataFrame | None = None,
    user_ids: DataFrame | None = None,
    rule_ids: DataFrame | None = None,
) -> Change:
    """Deletes URLs (or users, or rules) with everything that hangs on them.

    A deleted user takes their URLs and votes along; their reviews stay without reviewer.
    """
    t = tables
    # Each key set is read by several deletions: stored once, its size checked once.
    users = stored(_ids(user_ids, "user_id", t.users), "users")
    rules = stored(_ids(rule_ids, "rule_id", t.rules), "rules")
    few_users, few_rules = is_small(users), is_small(rules)
    owned = lookup_join(
        t.url_submissions.select("url_id", "user_id"), users, ["user_id"], "left_semi", ["url_id"], small=few_users
    )
    urls = stored(_ids(url_ids, "url_id", t.url_submissions).union(owned.select("url_id")).distinct(), "urls")
    few_urls = is_small(urls)
    removed = t.url_submissions.join(urls, "url_id", "left_semi").select("url_id")

    def without_urls(df: DataFrame, row_id: str) -> DataFrame:
        return lookup_join(df, urls, ["url_id"], "left_anti", [row_id], small=few_urls)

    votes = lookup_join(
        without_urls(t.votes, "vote_id"), users, ["user_id"], "left_anti", ["vote_id"], small=few_users, sizes_from=t.votes
    )
    matches = lookup_join(
        without_urls(t.url_rule_matches, "match_id"),
        rules,
        ["rule_id"],
        "left_anti",
        ["match_id"],
        small=few_rules,
        sizes_from=t.url_rule_matches,
    )
    gone = users.select(F.col("user_id").alias("reviewer_id"), F.lit(True).alias("_gone"))
    statuses = lookup_join(
        without_urls(t.statuses, "status_id"),
        gone,
        ["reviewer_id"],
        "left",
        ["status_id"],
        small=few_users,
        sizes_from=t.statuses,
    )
    statuses = statuses.withColumn("reviewer_id", F.when(F.col("_gone").isNull(), F.col("reviewer_id")))
    return Change(
        t.remembering().with_tables(
            users=shaped(t.users.join(users, "user_id", "left_anti"), "users"),
            url_submissions=shaped(t.url_submissions.join(urls, "url_id", "left_anti"), "url_submissions"),
            rules=shaped(t.rules.join(rules, "rule_id", "left_anti"), "rules"),
            url_rule_matches=shaped(matches, "url_rule_matches"),
            statuses=shaped(statuses, "statuses"),
            votes=shaped(votes, "votes"),
            url_score_comparisons=shaped(without_urls(t.url_score_comparisons, "rep_id"), "url_score_comparisons"),
        ),
        removed,
    )


def link_named_rules(
    tables: Tables, urls: DataFrame, rule_names: list[str], keyword: str, note: str
) -> DataFrame:
    """New matches between the given URLs and the rules picked by name or keyword pattern."""
    by_keyword = (F.col("rule_type") == "keyword") & like_any_case(F.col("pattern"), keyword)
    picked = tables.rules.where(F.col("rule_name").isin(*rule_names) | by_keyword).select("rule_id")
    return (
        with_catalogue(urls.select("url_id"), picked, "_rules")
        .select("url_id", F.explode("_rules.rule_id").alias("rule_id"), F.lit(note).alias("match_details"))
        .join(tables.url_rule_matches.select("url_id", "rule_id"), ["url_id", "rule_id"], "left_anti")
    )


# The rule that the subdomain job adds.
SUBDOMAIN_RULE = {
    "rule_name": "Suspicious Subdomain Count",
    "description": "Detects URLs with excessive subdomain levels",
    "pattern": r"^https?://([^/]+\.){4,}",
    "rule_type": "regex",
    "risk_level": "medium",
    "tld": None,
}
SUBDOMAIN_NOTE = "Matched: Multiple subdomain levels detected"


def add_rule_and_match(
    tables: Tables, rule: dict = SUBDOMAIN_RULE, note: str = SUBDOMAIN_NOTE, surplus: int = 4
) -> tuple[DataFrame, DataFrame]:
    """The catalogue with the rule added if its name is new, and the matches to add.

    A URL matches when it is at least ``surplus`` characters longer than its domain without
    dots. That holds for nearly every URL with a scheme; the rule's own pattern is stricter
    and runs through ``evaluate_rules``.
    """
    name = rule["rule_name"]
    highest = F.coalesce(tables.rules.agg(F.max("rule_id")).scalar(), F.lit(0))
    next_id = F.greatest(highest, F.lit(tables.last_ids.get("rules", 0))) + 1
    missing = tables.rules.where(F.col("rule_name") == name).agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
    added = missing.select(next_id.alias("rule_id"), *[F.lit(v).cast("string").alias(k) for k, v in rule.items()])
    rules = tables.rules.unionByName(shaped(added, "rules"))
    rule_id = rules.where(F.col("rule_name") == name).agg(F.min("rule_id")).scalar()
    # Ids and rule names are unique, so the URLs already linked are distinct.
    linked = rollups.keys_of(
        lookup_join(
            tables.url_rule_matches, rules.where(F.col("rule_name") == name).select("rule_id"), ["rule_id"], "left_semi", ["match_id"]
        )
    )
    bare = F.length(F.replace(F.col("url_domain"), F.lit("."), F.lit("")))
    matches = (
        tables.url_submissions.where(F.length("url") - bare >= surplus)
        .select("url_id")
        .join(linked, "url_id", "left_anti")
        .select("url_id", rule_id.alias("rule_id"), F.lit(note).alias("match_details"))
    )
    return rules, matches
