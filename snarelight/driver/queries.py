"""One callable per operator: (spark, sf_dir) -> DataFrame over the derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snarelight.driver.tables import AS_OF, VOTE_LOG, derive, input_rows, read, triage_tables
from snarelight.functions.urls import url_scheme, with_url_parts
from snarelight.model import IDS, Tables
from snarelight.operators import sessions, voting
from snarelight.plans import audit, feed, intake, jobs, maintenance, reports, rules_engine, search
from snarelight.plans.search import Search
from snarelight.session import new_folder
from snarelight.sources import export_csv, feed_csv, snapshots
from snarelight.streaming import jobs as streams

Query = Callable[[SparkSession, str], DataFrame]

# Parameters shared with the SQL in ``oracles``.
FEED_OWNER = "customer.7@example.com"
CHECKED_URL = "https://bit.ly/p/11"
CHECKED_RULE = "NATION_3"
SEARCH = Search(text="a%ount", result_code="PHISHING", rule_id="4")
FACETS = Search(text="P/1", result_code="LEGITIMATE", user_id="7", rule_id=4)
VIEWER = 7
LINK_NAMES = ["NATION_3", "NATION_4"]
LONG_URL = 38


def _report(build: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(triage_tables(spark, sf_dir))


def _labelled(result: intake.Intake, *columns: str) -> DataFrame:
    return result.labelled().select(*columns)


def _reclassified(t: Tables) -> Tables:
    return maintenance.reclassify_by_votes(t, AS_OF).tables


def _feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed written as CSV files and read back with the feed reader."""
    folder = new_folder(spark, "feed")
    written = input_rows(spark, sf_dir, "feed").repartitionByRange("seq").sortWithinPartitions("seq")
    export_csv.write_csv(written.select("dateadded", "url", "url_status", "threat", "tags", "last_online"), folder)
    rows = feed_csv.read_feed(spark, folder)
    return feed.feed_details(rows, AS_OF).drop("result_code")


def _export_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "export")
    export_csv.write_csv(search.export_rows(triage_tables(spark, sf_dir), Search(), limit=None), folder)
    return spark.read.options(header=True, escape='"').csv(folder)


def _apply_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions stored, reclassified by votes, stored again and read back."""
    root = new_folder(spark, "snapshots")
    tables = triage_tables(spark, sf_dir)
    snapshots.save(tables, root)
    stored, _ = snapshots.load(spark, root)
    snapshots.save(_reclassified(stored), root, ["url_submissions"])
    return snapshots.load(spark, root)[0].url_submissions


def _apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by change sets: reclassified rows and deleted matches only are written."""
    root = new_folder(spark, "snapshots")
    snapshots.save(triage_tables(spark, sf_dir), root)
    stored, _ = snapshots.load(spark, root)
    snapshots.save_changes(stored, _reclassified(stored), root, ["url_submissions"])
    cleaned = maintenance.cleanup_rule_matches(stored).tables
    snapshots.save_changes(stored, cleaned, root, ["url_rule_matches"])
    tables, _ = snapshots.load(spark, root)
    ids = [getattr(tables, n).select(F.lit(n).alias("table_name"), F.col(IDS[n]).alias("row_id"), c) for n, c in
           (("url_submissions", F.col("result_code")), ("url_rule_matches", F.lit(None).cast("string").alias("result_code")))]
    return ids[0].unionByName(ids[1])


def _viewer_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triage_tables(spark, sf_dir)
    asked = t.url_submissions.select("url_id", (F.col("url_id") % 100).alias("user_id"))
    return reports.viewer_votes(t, asked)


def _available_rules(t: Tables) -> DataFrame:
    names = F.array_join(F.transform("available_rules", lambda r: r["rule_name"]), ", ")
    return search.available_rules(t, t.url_submissions).select("url_id", names.alias("available_rules"), F.col("available_count").cast("bigint"))


def _link_named_rules(t: Tables) -> DataFrame:
    urls = t.url_submissions.where(F.col("tld") == ".tk")
    return intake.link_named_rules(t, urls, LINK_NAMES, "verify", "auto")


def _removal_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(
        spark,
        sf_dir,
        "select l_orderkey * 25 + l_partkey % 23 as match_id, l_orderkey as url_id from {lineitem} where l_tax > 0.04",
    )


def _remove_rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = intake.remove_rule_matches(triage_tables(spark, sf_dir), _removal_requests(spark, sf_dir))
    kept = change.tables.url_rule_matches.select("match_id", "url_id", F.lit("kept").alias("outcome"))
    return kept.unionByName(change.problems.withColumn("outcome", F.lit("not_found")))


def _delete_submissions(t: Tables) -> DataFrame:
    doomed = t.url_submissions.where(F.col("result_code") == "SUSPICIOUS").select("url_id")
    users = t.users.where(F.col("role") == "analyst").select("user_id")
    rules = t.rules.where(F.col("risk_level").isNull()).select("rule_id")
    left = intake.delete_submissions(t, doomed, users, rules).tables
    lines = [
        getattr(left, name).select(F.lit(name).alias("table_name"), F.col(IDS[name]).alias("row_id")) for name in Tables.names()
    ]
    unreviewed = left.statuses.where(F.col("reviewer_id").isNull())
    lines.append(unreviewed.select(F.lit("statuses without reviewer").alias("table_name"), F.col("status_id").alias("row_id")))
    result = lines[0]
    for line in lines[1:]:
        result = result.unionByName(line)
    return result


def _added_rule_matches(t: Tables) -> DataFrame:
    rules, matches = intake.add_rule_and_match(t)
    return matches.join(rules.select("rule_id", "rule_name"), "rule_id").select("url_id", "rule_name", "match_details")


def _submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = intake.submit_urls(triage_tables(spark, sf_dir), input_rows(spark, sf_dir, "requests"))
    return _labelled(result, "seq", "user_id", "url", "url_domain", "tld", "scheme", "url_length", "result_code", "reason")


def _stored_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triage_tables(spark, sf_dir)
    accepted = intake.submit_urls(t, input_rows(spark, sf_dir, "requests")).accepted
    return intake.store_submissions(t, accepted, AS_OF).tables.url_submissions.drop("updated_at")


def _register(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = intake.register_users(triage_tables(spark, sf_dir), input_rows(spark, sf_dir, "account_requests"))
    return _labelled(result, "seq", "name", "email", "case_variant", "reason")


def _add_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = intake.add_rule_matches(triage_tables(spark, sf_dir), input_rows(spark, sf_dir, "match_requests"))
    return _labelled(result, "url_id", "rule_id", "match_details", "reason").groupBy(
        "url_id", "rule_id", "match_details", "reason"
    ).agg(F.count(F.lit(1)).alias("request_count"))


def _feed_import(limit: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        imported = feed.feed_import(triage_tables(spark, sf_dir), input_rows(spark, sf_dir, "feed"), AS_OF, limit)
        return imported.inserted.drop("result_code")

    return query


def _stored_feed(spark: SparkSession, sf_dir: str) -> Tables:
    t = triage_tables(spark, sf_dir)
    imported = feed.feed_import(t, input_rows(spark, sf_dir, "feed"), AS_OF)
    return feed.store_feed(t, imported.inserted, AS_OF).tables


def _stored_feed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _stored_feed(spark, sf_dir)
    owner = t.users.where(F.col("email") == feed.FEED_EMAIL).select("user_id")
    return t.url_submissions.join(F.broadcast(owner), "user_id", "left_semi").drop("updated_at")


def _stored_feed_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_feed(spark, sf_dir).statuses.where(F.col("label").startswith(feed.LABEL_PREFIX))


def _stored_community_statuses(t: Tables) -> DataFrame:
    return maintenance.community_statuses(t, AS_OF).tables.statuses.where(F.col("label").contains("Community"))


def _feed_import_counts(limit: int) -> Query:
    return lambda spark, sf_dir: feed.feed_import(
        triage_tables(spark, sf_dir), input_rows(spark, sf_dir, "feed"), AS_OF, limit
    ).summary


def _job_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.job_reports(triage_tables(spark, sf_dir), AS_OF, input_rows(spark, sf_dir, "feed"))


def _fold_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.fold_votes(input_rows(spark, sf_dir, "vote_log")).drop("vote_id")


#: The events arrive in so many parts; the stream is run again after each.
PARTS = 3
#: Every so many events arrive one part late.
LATE_EVENTS = 50
#: Part of the events by time, and by number, as a number from 0.
PART_OF_TIME = f"""
select e.*, least({PARTS - 1}, cast(floor({PARTS} * (unix_micros(cast(e.ts as timestamp)) - (select min(unix_micros(cast(ts as timestamp))) from {{events}}))
    / ((select max(unix_micros(cast(ts as timestamp))) - min(unix_micros(cast(ts as timestamp))) from {{events}}) + 1)) as int))
  + case when e.event_id % {LATE_EVENTS} = 0 then 1 else 0 end as part
from {{events}} e
"""
PART_OF_NUMBER = f"""
select e.*, cast(floor({PARTS} * (e.event_id - (select min(event_id) from {{events}}))
    / ((select max(event_id) - min(event_id) from {{events}}) + 1)) as int) as part
from {{events}} e
"""


def _arriving(spark: SparkSession, sf_dir: str, parts: str, run) -> None:
    """Writes the events part by part and lets ``run`` take each part over from the stream of all that has arrived."""
    events = read(spark, sf_dir, "events")
    folder = new_folder(spark, "events")
    dealt = spark.sql(parts, events=events)
    for part in range(PARTS + (parts == PART_OF_TIME)):
        dealt.where(F.col("part") == part).drop("part").write.parquet(f"{folder}/arrived-{part}")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/arrived-*")
        _finish(run(stream))


def _finish(query) -> None:
    query.awaitTermination()


def _run_votes(spark: SparkSession, sf_dir: str) -> str:
    out = new_folder(spark, "votes")
    _arriving(spark, sf_dir, PART_OF_TIME, lambda events: streams.stream_votes(spark.sql(VOTE_LOG, events=events), out))
    return out


def _stream_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.current_votes(spark, _run_votes(spark, sf_dir)).drop("vote_id")


def _late_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{_run_votes(spark, sf_dir)}/late").select("event_id", "ts", "user_id", "url_id", "vote_value", "watermark")


def _stream_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "submissions")
    tables = triage_tables(spark, sf_dir)
    requests = lambda events: input_rows(spark, sf_dir, "requests", events=events)
    _arriving(spark, sf_dir, PART_OF_NUMBER, lambda events: streams.stream_submit(requests(events), tables, out))
    accepted = spark.read.parquet(f"{out}/accepted")
    hits = spark.read.parquet(f"{out}/hits").select("seq", "rule_id")
    return accepted.join(hits, "seq", "left").select("seq", "user_id", "url", "url_domain", "tld", "result_code", "rule_id")


def _stream_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "feed")
    tables = triage_tables(spark, sf_dir)
    rows = lambda events: input_rows(spark, sf_dir, "feed", events=events)
    _arriving(spark, sf_dir, PART_OF_NUMBER, lambda events: streams.stream_feed(rows(events), tables, out, AS_OF))
    return spark.read.parquet(f"{out}/accepted").drop("batch", "result_code")


_SESSION = "user_id bigint, session_start timestamp_ntz, last_seen timestamp_ntz, expires_at timestamp_ntz, event_count bigint"


def _run_sessions(spark: SparkSession, sf_dir: str) -> str:
    out = new_folder(spark, "sessions")
    events = read(spark, sf_dir, "events")
    # A file stream wants a folder or a pattern; the braces let the table be a single file too.
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/{{events.parquet}}")
    _finish(streams.stream_sessions(stream.select("user_id", "ts"), out))
    return out


def _stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions the stream has closed; the last ones stay open until later events arrive."""
    return spark.read.schema(_SESSION).parquet(f"{_run_sessions(spark, sf_dir)}/sessions")


def _all_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed sessions, and the open ones from the stream's state."""
    out = _run_sessions(spark, sf_dir)
    return spark.read.schema(_SESSION).parquet(f"{out}/sessions").unionByName(streams.open_sessions(spark, out))


def _parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_url_parts(read(spark, sf_dir, "pages").select("page_id", "url"))
    return pages.select("page_id", "url_domain", "tld", url_scheme(F.col("url")).alias("scheme"))


def _changed(build: Callable[[Tables], maintenance.Change], table: str) -> Query:
    return _report(lambda t: getattr(build(t).tables, table))


def _rounded_scores(t: Tables) -> DataFrame:
    table = maintenance.recompute_scores(t).tables.url_score_comparisons
    return table.withColumn("avg_score", F.round("avg_score", 6))


QUERIES: dict[str, Query] = {
    "users_by_role": _report(reports.users_by_role),
    "user_roles": _report(reports.user_roles),
    "phishing_urls": _report(reports.phishing_urls),
    "result_counts": _report(reports.result_counts),
    "contributor_stats": _report(lambda t: reports.contributor_stats(t, None)),
    "contributor_stats_top": _report(reports.contributor_stats),
    "rule_usage": _report(reports.rule_usage),
    "vote_distribution": _report(reports.vote_distribution),
    "url_listing": _report(reports.url_listing),
    "vote_conflicts": _report(lambda t: reports.vote_conflicts(t, None)),
    "vote_conflicts_top": _report(reports.vote_conflicts),
    "risk_rankings": _report(lambda t: reports.risk_rankings(t).withColumn("avg_vote_value", F.round("avg_vote_value", 6))),
    "risk_rankings_all": _report(
        lambda t: reports.risk_rankings(t, None).withColumn("avg_vote_value", F.round("avg_vote_value", 6))
    ),
    "url_analysis_report": _report(reports.url_analysis_report),
    "top_rule_submitters": _report(
        lambda t: reports.top_rule_submitters(t).withColumn("avg_rules_per_url", F.round("avg_rules_per_url", 6))
    ),
    "risk_categories": _report(reports.risk_categories),
    "review_timeline": _report(
        lambda t: reports.review_timeline(t, AS_OF).withColumn(
            "days_between_submission_and_review", F.round("days_between_submission_and_review", 6)
        )
    ),
    "rule_effectiveness": _report(reports.rule_effectiveness),
    "tld_submission_rank": _report(reports.tld_submission_rank),
    "dashboard_totals": _report(reports.dashboard_totals),
    "recent_urls": _report(reports.recent_urls),
    "search_urls": _report(lambda t: search.search_urls(t, SEARCH, VIEWER)),
    "search_urls_all": _report(lambda t: search.search_urls(t, Search(text="P/1"), VIEWER, None)),
    "status_facet": _report(lambda t: search.status_facet(t, FACETS.without("user_id"))),
    "user_facet": _report(lambda t: search.user_facet(t, FACETS)),
    "search_facets": _report(lambda t: search.search_facets(t, FACETS)),
    "rule_catalog": _report(reports.rule_catalog),
    "url_dossier": _report(search.url_dossier),
    "available_rules": _report(_available_rules),
    "viewer_votes": _viewer_votes,
    "feed_summary": _report(lambda t: reports.feed_summary(t, FEED_OWNER)),
    "vote_tally": _report(reports.vote_tally),
    "health_count": _report(reports.health_count),
    "inserted_url_check": _report(lambda t: reports.inserted_url_check(t, CHECKED_URL)),
    "recently_updated": _report(lambda t: reports.recently_updated(_reclassified(t), AS_OF)),
    "status_text_search": _report(lambda t: reports.status_text_search(t, "Seed_REVIEW")),
    "label_text_search": _report(lambda t: reports.status_text_search(t, "CONFIRMED", "label")),
    "url_display": _report(search.display_rows),
    "activity_counts": _report(reports.activity_counts),
    "rule_match_check": _report(lambda t: reports.rule_match_check(t, CHECKED_RULE)),
    "top_scores": _report(reports.top_scores),
    "match_validity": _report(reports.match_validity),
    "feed_rows": _feed_rows,
    "export_urls": _export_urls,
    "apply_snapshot": _apply_snapshot,
    "apply_changes": _apply_changes,
    "parse_urls": _parsed_pages,
    "submit_urls": _submit,
    "store_submissions": _stored_submissions,
    "link_named_rules": _report(_link_named_rules),
    "add_rule_matches": _add_matches,
    "remove_rule_matches": _remove_rule_matches,
    "delete_submissions": _report(_delete_submissions),
    "fold_votes": _fold_votes,
    "reclassify_by_votes": _changed(lambda t: maintenance.reclassify_by_votes(t, AS_OF), "url_submissions"),
    "annotate_admin_statuses": _changed(maintenance.annotate_admin_statuses, "statuses"),
    "cleanup_inactive": _changed(lambda t: maintenance.cleanup_inactive(t, AS_OF), "url_submissions"),
    "cleanup_inactive_scores": _changed(lambda t: maintenance.cleanup_inactive(t, AS_OF), "url_score_comparisons"),
    "add_rule_and_match": _report(_added_rule_matches),
    "recompute_scores": _report(_rounded_scores),
    "community_statuses": _report(lambda t: maintenance.new_community_statuses(t, AS_OF)),
    "community_statuses_stored": _report(_stored_community_statuses),
    "cleanup_rule_matches": _changed(maintenance.cleanup_rule_matches, "url_rule_matches"),
    "promote_users": _changed(maintenance.promote_users, "users"),
    "auto_classify": _changed(lambda t: maintenance.auto_classify(t, AS_OF), "url_submissions"),
    "auto_classify_strict": _changed(lambda t: maintenance.auto_classify(t, AS_OF, strict=True), "url_submissions"),
    "feed_import": _feed_import(feed.FEED_LIMIT),
    "feed_import_25": _feed_import(25),
    "feed_import_all": _feed_import(0),
    "feed_import_counts": _feed_import_counts(feed.FEED_LIMIT),
    "feed_import_counts_25": _feed_import_counts(25),
    "store_feed_urls": _stored_feed_urls,
    "store_feed_statuses": _stored_feed_statuses,
    "ensure_feed_user": _report(lambda t: feed.ensure_feed_user(t, AS_OF).users),
    "register_users": _register,
    "maintenance_run": _job_reports,
    "evaluate_rules": _report(lambda t: rules_engine.evaluate_rules(t, LONG_URL)),
    "integrity_audit": _report(audit.integrity_audit),
    "user_sessions": lambda spark, sf_dir: sessions.user_sessions(read(spark, sf_dir, "events").select("user_id", "ts")),
    "stream_submit": _stream_submit,
    "stream_votes": _stream_votes,
    "stream_feed": _stream_feed,
    "stream_sessions": _stream_sessions,
    "stream_sessions_all": _all_stream_sessions,
    "stream_votes_late": _late_votes,
}
