"""Search with facets, the dossier of a URL, and the export rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snarelight.functions.text import code_label, like_any_case, minute_text, percent_text
from snarelight.model import RISK_LEVELS, Tables
from snarelight.operators import rollups
from snarelight.operators.catalogue import with_catalogue
from snarelight.operators.skew import lookup_join
from snarelight.operators.topk import rows_of, top_rows, with_people_and_votes


@dataclass(frozen=True)
class Search:
    """Search form values. Ids may be text as typed by a user; text that is no number matches nothing."""

    text: str = ""
    result_code: str = ""
    user_id: str | int | None = None
    rule_id: str | int | None = None
    tld: str = ""

    def without(self, *names: str) -> "Search":
        cleared = {"text": "", "result_code": "", "user_id": None, "rule_id": None, "tld": ""}
        return Search(**{f: cleared[f] if f in names else getattr(self, f) for f in cleared})


def _given(value) -> bool:
    return value is not None and value != ""


def _same_id(column: str, value) -> Column:
    return F.col(column) == F.lit(str(value)).try_cast("bigint")


#: Filters that facets count by: each facet leaves its own filter out.
FACETS = ("result_code", "user_id", "tld")


def _passes(search: Search, name: str) -> Column | None:
    """The test of one filter of ``FACETS``, or None where the search doesn't set it."""
    value = getattr(search, name)
    if not _given(value):
        return None
    return _same_id(name, value) if name == "user_id" else F.col(name) == value


def matching(tables: Tables, search: Search) -> DataFrame:
    """The submissions a search selects."""
    urls = tables.url_submissions
    if search.text:
        urls = urls.where(like_any_case(F.col("url"), search.text) | like_any_case(F.col("url_domain"), search.text))
    for name in FACETS:
        if (test := _passes(search, name)) is not None:
            urls = urls.where(test)
    if _given(search.rule_id):
        with_rule = tables.url_rule_matches.where(_same_id("rule_id", search.rule_id))
        urls = urls.join(rollups.keys_of(with_rule), "url_id", "left_semi")
    return urls


def search_urls(
    tables: Tables, search: Search = Search(), viewer_user_id: int | None = None, limit: int | None = 100
) -> DataFrame:
    """Newest matching URLs with submitter, votes, rule count and the viewer's own vote.

    ``limit=None`` returns every match.
    """
    order = [F.desc("created_at"), F.desc("url_id")]
    found = matching(tables, search).select(
        "url_id", "user_id", "url", "url_domain", "tld", "result_code", "created_at"
    )
    matches, votes = tables.url_rule_matches, tables.votes
    if limit is not None:
        found = top_rows(found, order, limit)
        matches = rows_of(matches, found, "url_id", limit)
        votes = rows_of(votes, found, "url_id", limit)
    rules = rollups.rules_by_url(matches).select("url_id", F.size("rule_ids").cast("bigint").alias("rule_count"))
    rows = with_people_and_votes(tables, found, limit).join(rules, "url_id", "left")
    if viewer_user_id is None:
        rows = rows.withColumn("current_user_vote", F.lit(None).cast("int"))
    else:
        own = votes.where(F.col("user_id") == viewer_user_id).groupBy("url_id").agg(
            F.max("vote_value").alias("current_user_vote")
        )
        rows = rows.join(own, "url_id", "left")
    return (
        rollups.zero_if_null(rows, "rule_count")
        .select(
            "url_id",
            "url",
            "url_domain",
            "tld",
            "result_code",
            "created_at",
            "submitter",
            "phishing_votes",
            "legitimate_votes",
            "rule_count",
            "current_user_vote",
        )
        .orderBy(*order)
    )


def status_facet(tables: Tables, search: Search = Search()) -> DataFrame:
    """Counts per result code under the other filters; a missing code is ''."""
    found = matching(tables, search.without("result_code"))
    return found.groupBy(code_label(F.col("result_code"), "").alias("result_code")).agg(
        F.count(F.lit(1)).alias("url_count")
    )


def user_facet(tables: Tables, search: Search = Search()) -> DataFrame:
    found = matching(tables, search.without("user_id"))
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("url_count"))


def search_facets(tables: Tables, search: Search = Search()) -> DataFrame:
    """(facet, value, url_count) of every facet and the ``total`` of the search, from one scan.

    Each URL carries a bit per filter it passes. It counts for a facet if it passes all filters but the
    facet's own, and for the total (value NULL) if it passes all. URLs that fail two filters go at the
    scan, and counts are added up before the one shuffle. Values are text; a missing result code is '',
    a missing user or tld NULL. A facet without URLs, the total included, has no row.
    """
    tests = [_passes(search, name) for name in FACETS]
    bits = [F.lit(1 << i) if test is None else F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)]
    every = (1 << len(FACETS)) - 1
    rows = matching(tables, search.without(*FACETS)).select(*FACETS, reduce(Column.bitwiseOR, bits).alias("passed"))
    rows = rows.where(F.bit_count("passed") >= len(FACETS) - 1)
    values = [code_label(F.col("result_code"), ""), F.col("user_id").cast("string"), F.col("tld")]

    def entry(facet: str, value: Column, own: int) -> Column:
        counts = F.col("passed").bitwiseOR(own) == every
        return F.when(counts, F.struct(F.lit(facet).alias("facet"), value.alias("value")))

    entries = [entry(name, value, 1 << i) for i, (name, value) in enumerate(zip(FACETS, values, strict=True))]
    entries.append(entry("total", F.lit(None).cast("string"), 0))
    return rows.select(F.inline(F.array_compact(F.array(*entries)))).groupBy("facet", "value").agg(
        F.count(F.lit(1)).alias("url_count")
    )


def export_rows(tables: Tables, search: Search = Search(), limit: int | None = 100) -> DataFrame:
    """The columns of the CSV export, in file order and with its headings."""
    headings = {
        "url": "URL",
        "url_domain": "Domain",
        "tld": "TLD",
        "result_code": "Status",
        "submitter": "Submitter",
        "created_at": "Submitted",
        "phishing_votes": "Phishing votes",
        "legitimate_votes": "Legitimate votes",
    }
    order = [F.desc("created_at"), F.desc("url_id")]
    found = matching(tables, search).select(
        "url_id", "user_id", "url", "url_domain", "tld", "result_code", "created_at"
    )
    if limit is not None:
        found = top_rows(found, order, limit)
    rows = with_people_and_votes(tables, found, limit).orderBy(*order)
    return rows.select(*[F.col(c).alias(h) for c, h in headings.items()])


def display_rows(tables: Tables) -> DataFrame:
    """Per URL what a page shows of it: submission time to the minute, and the share of phishing votes."""
    votes = rollups.votes_by_url(tables.votes).select("url_id", "phishing_votes", "legitimate_votes")
    cast = F.col("phishing_votes") + F.col("legitimate_votes")
    share = F.when(cast > 0, 100.0 * F.col("phishing_votes") / cast)
    return tables.url_submissions.select("url_id", "url", "created_at").join(votes, "url_id", "left").select(
        "url_id", "url", minute_text(F.col("created_at")).alias("submitted"), percent_text(share).alias("phishing_share")
    )


def available_rules(tables: Tables, url_ids: DataFrame) -> DataFrame:
    """Per URL asked for, the rules it has not matched, by name.

    The catalogue is attached as one array and the URL's own rules are filtered out, so
    no (URL, rule) pairs are formed.
    """
    asked = url_ids.select("url_id").distinct()
    urls = lookup_join(tables.url_submissions.select("url_id"), asked, ["url_id"], "left_semi")
    matches = tables.url_rule_matches.select("url_id", "rule_id")
    matches = lookup_join(matches, asked, ["url_id"], "left_semi", ["rule_id"])
    listed = tables.rules.select("rule_name", "rule_id", "rule_type", "risk_level")
    taken = urls.join(rollups.rules_by_url(matches), "url_id", "left")
    own = F.coalesce("rule_ids", F.array().cast("array<bigint>"))
    free = F.filter("catalogue", lambda rule: ~F.array_contains(own, rule["rule_id"]))
    return with_catalogue(taken, listed, "catalogue").select(
        "url_id", free.alias("available_rules"), F.size(free).alias("available_count")
    )


def dossier_sections(tables: Tables, url_ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """All that is known about each URL (all URLs, or the ids given), one table per section."""

    def wanted(df: DataFrame, row_id: str) -> DataFrame:
        if url_ids is None:
            return df
        return lookup_join(df, url_ids.select("url_id").distinct(), ["url_id"], "left_semi", [row_id])

    def people(key: str, *roles: str) -> DataFrame:
        return tables.users.select(F.col("user_id").alias(key), *[F.col(c).alias(a) for c, a in map(str.split, roles)])

    submitters = people("user_id", "name submitter_name", "email submitter_email", "role submitter_role")
    reviewers = people("reviewer_id", "name reviewer_name")
    voters = people("user_id", "name voter_name", "role voter_role")
    rules = tables.rules.select("rule_id", "rule_name", "risk_level", "rule_type")
    t = tables
    header = lookup_join(
        wanted(t.url_submissions, "url_id"), submitters, ["user_id"], "inner", ["url_id"], sizes_from=t.url_submissions
    )
    matches = lookup_join(
        wanted(t.url_rule_matches, "match_id"), rules, ["rule_id"], "inner", ["match_id"], sizes_from=t.url_rule_matches
    )
    reviews = lookup_join(
        wanted(t.statuses, "status_id"), reviewers, ["reviewer_id"], "left", ["status_id"], sizes_from=t.statuses
    )
    votes = lookup_join(wanted(t.votes, "vote_id"), voters, ["user_id"], "inner", ["vote_id"], sizes_from=t.votes)
    return {
        "url": header,
        "rule": matches,
        "status": reviews.select(
            "url_id", "status_id", "label", "result_code", "description", "created_at", "reviewer_name"
        ),
        "vote": votes.select("url_id", "vote_id", "voter_name", "voter_role", "vote_value", "created_at"),
        "score": wanted(t.url_score_comparisons, "rep_id"),
    }


def url_dossier(tables: Tables, url_ids: DataFrame | None = None) -> DataFrame:
    """The dossier as one table: a row per fact with its section, other sections' columns NULL.

    Facts stay rows rather than nested lists: a URL with a very large share of the votes
    must not become one record.
    """
    parts = [df.withColumn("section", F.lit(name)) for name, df in dossier_sections(tables, url_ids).items()]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)


def in_page_order(dossier: DataFrame, by_severity: bool = False) -> DataFrame:
    """Rules by risk level downwards (as text, or by severity) and name, other sections newest first."""
    risk = F.col("risk_level")
    if by_severity:
        risk = F.array_position(F.lit(list(RISK_LEVELS)), risk)
    return dossier.orderBy(
        "url_id",
        "section",
        F.desc_nulls_last(F.when(F.col("section") == "rule", risk)),
        F.asc_nulls_first("rule_name"),
        F.desc_nulls_last("created_at"),
        "status_id",
        "vote_id",
        "rep_id",
    )
