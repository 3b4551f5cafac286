"""Expected results on the small seed data set."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import DAY, rows, table
from snarelight.plans import audit, feed, intake, jobs, maintenance, reports, rules_engine, search
from snarelight.plans.search import Search


def test_counts(seed):
    assert dict(rows(reports.result_counts(seed))) == {"PHISHING": 4, "LEGITIMATE": 4, "SUSPICIOUS": 2}
    assert rows(reports.health_count(seed)) == [(10,)]
    assert rows(reports.dashboard_totals(seed)) == [(10, 4, 4, 2, 0, 5, 8)]
    assert rows(reports.activity_counts(seed)) == [(10, 5)]
    assert rows(reports.match_validity(seed)) == [(11, 11)]


def test_contributors(seed):
    stats = reports.contributor_stats(seed).drop("user_id", "email", "role")
    assert rows(stats) == [("Priya Nair", 4, 4, 0, 0), ("Olga Brandt", 3, 0, 1, 2), ("Tomas Ferreira", 3, 0, 3, 0)]


def test_rule_usage(seed):
    assert rows(reports.rule_usage(seed), "rule_id", "urls_matched") == [
        (1, 4), (3, 3), (2, 1), (5, 1), (8, 1), (7, 1), (4, 0), (6, 0)
    ]


def test_vote_distribution(seed):
    got = {r[0]: r[1:] for r in rows(reports.vote_distribution(seed), "url_id", "phishing_votes", "legitimate_votes")}
    assert got == {1: (2, 0), 2: (0, 1), 3: (1, 0), 4: (0, 1), 5: (1, 0)} | {i: (0, 0) for i in range(6, 11)}


def test_listing_has_null_names_without_rules(seed):
    got = {r[0]: r[1:] for r in rows(reports.url_listing(seed), "url_id", "matched_rules_count", "matched_rule_names")}
    assert got[1] == (3, "Suspicious Domain Pattern, Suspicious Keywords, Suspicious TLD")
    assert got[2] == (0, None)


def test_vote_conflicts(seed):
    got = rows(reports.vote_conflicts(seed), "url_id", "phishing_votes", "legitimate_votes", "total_votes")
    assert got == [(5, 1, 0, 1)]


def test_vote_conflicts_count_votes_once_per_equal_review(spark, seed):
    twice = seed.statuses.unionByName(seed.statuses.withColumn("status_id", F.col("status_id") + 100))
    got = rows(reports.vote_conflicts(seed.with_tables(statuses=twice)), "url_id", "phishing_votes", "total_votes")
    assert got == [(5, 2, 2)]


@pytest.mark.parametrize("limit", [20, None])
def test_risk_rankings(seed, limit):
    got = rows(reports.risk_rankings(seed, limit), "url_id", "risk_score", "risk_rank", "agreement_status")
    assert got[:3] == [(3, 0.92, 1, "Phishing Agreement"), (1, 0.85, 2, "Phishing Agreement"), (5, 0.65, 3, "Phishing Agreement")]
    assert got[3:8] == [(i, 0.5, 4, "Uncertain") for i in range(6, 11)]
    assert got[8:] == [(2, 0.05, 9, "Legitimate Agreement"), (4, 0.03, 10, "Legitimate Agreement")]


def test_risk_rankings_limit_cuts_ties_by_id(seed):
    assert rows(reports.risk_rankings(seed, 5), "url_id", "risk_rank") == [(3, 1), (1, 2), (5, 3), (6, 4), (7, 4)]


def test_url_analysis_report(seed):
    got = {
        r[0]: r[1:]
        for r in rows(
            reports.url_analysis_report(seed),
            "url_id", "rules_triggered", "voters_count", "review_count", "risk_assessment", "external_score",
        )
    }
    assert got == {
        1: (3, 2, 1, "High Risk", 0.85),
        2: (0, 1, 1, "No Rules Matched", 0.05),
        3: (2, 1, 1, "Medium Risk", 0.92),
        4: (0, 1, 1, "No Rules Matched", 0.03),
        5: (1, 1, 1, "Low Risk", 0.65),
        6: (2, 0, 0, "Medium Risk", 0.0),
        8: (1, 0, 0, "Low Risk", 0.0),
        9: (2, 0, 0, "Medium Risk", 0.0),
    }


def test_top_rule_submitters(seed):
    got = rows(reports.top_rule_submitters(seed), "name", "urls_submitted", "total_rule_matches", "avg_rules_per_url")
    assert got == [("Priya Nair", 4, 9, 2.25), ("Olga Brandt", 2, 2, 1.0)]


def test_risk_categories(seed):
    assert rows(reports.risk_categories(seed), "category", "url_id", "rule_count") == [
        ("High_Risk_Phishing", 1, 2),
        ("High_Risk_Phishing", 3, 2),
        ("Suspicious_TLD", 1, 3),
        ("Suspicious_TLD", 6, 2),
        ("Suspicious_TLD", 9, 2),
    ]


def test_rule_effectiveness(seed):
    got = {
        r[0]: r[1:]
        for r in rows(
            reports.rule_effectiveness(seed),
            "rule_id", "urls_matched", "phishing_matches", "legitimate_matches", "phishing_accuracy_percent",
        )
    }
    assert got == {
        1: (4, 4, 0, 100.0), 3: (3, 3, 0, 100.0), 2: (1, 1, 0, 100.0), 7: (1, 1, 0, 100.0), 5: (1, 0, 0, 0.0), 8: (1, 0, 0, 0.0),
    }


def test_tld_rank_totals(seed):
    got = rows(reports.tld_submission_rank(seed), "tld", "submission_rank_in_tld", "total_submissions_in_tld")
    assert sorted(got) == [(".com", i, 5) for i in range(1, 6)] + [(".ly", 1, 1)] + [(".tk", i, 3) for i in range(1, 4)]


def test_review_timeline_days(seed):
    later = seed.statuses.withColumn("created_at", F.expr("created_at + interval 36 hours"))
    got = rows(reports.review_timeline(seed.with_tables(statuses=later), DAY), "url_id", "days_between_submission_and_review")
    assert dict(got) == {i: 1.5 for i in range(1, 6)} | {i: None for i in range(6, 11)}
    assert rows(reports.review_timeline(seed, DAY + timedelta(days=31))) == []


def test_search(seed):
    found = search.search_urls(seed, Search(text="ACCOUNT", rule_id="1"), viewer_user_id=3)
    got = {r.url_id: (r.phishing_votes, r.rule_count, r.current_user_vote) for r in found.collect()}
    assert got == {1: (2, 3, 1), 3: (1, 2, 1), 6: (0, 2, None), 9: (0, 2, None)}
    assert search.search_urls(seed, Search(user_id="abc")).count() == 0
    assert search.search_urls(seed, Search(text="\\b")).count() == 0
    assert search.search_urls(seed, Search(text="verify_id")).count() == 1
    assert search.search_urls(seed, limit=3).count() == 3


def test_facets(seed):
    pending = seed.url_submissions.withColumn("result_code", F.when(F.col("url_id") < 9, F.col("result_code")))
    t = seed.with_tables(url_submissions=pending)
    chosen = Search(text="://", result_code="PHISHING", user_id=3)
    assert dict(rows(search.status_facet(t, chosen))) == {"PHISHING": 3, "": 1}
    assert dict(rows(search.user_facet(t, chosen))) == {3: 3}


def test_dossier_and_available_rules(seed, spark):
    ids = spark.createDataFrame([(1,)], "url_id bigint")
    dossier = search.url_dossier(seed, ids)
    title = F.coalesce("rule_name", "label", "voter_name", "external_source", "submitter_name")
    got = rows(search.in_page_order(dossier), "section", title)
    assert got == [
        ("rule", "Suspicious TLD"),
        ("rule", "Suspicious Domain Pattern"),
        ("rule", "Suspicious Keywords"),
        ("score", "Engine Alpha"),
        ("status", "Confirmed Phishing"),
        ("url", "Priya Nair"),
        ("vote", "Priya Nair"),
        ("vote", "Olga Brandt"),
    ]
    by_severity = search.in_page_order(dossier, by_severity=True).where("section = 'rule'")
    assert rows(by_severity, "risk_level") == [("high",), ("high",), ("medium",)]
    free = search.available_rules(seed, ids).first()
    assert [r.rule_id for r in free.available_rules] == [2, 4, 5, 6, 8]


def test_single_lookups(seed, spark):
    url = "https://bit.ly/suspicious-link-xyz"
    assert rows(reports.inserted_url_check(seed, url), "url_id", "rules_matched") == [(5, 1)]
    assert rows(reports.rule_match_check(seed, "Long URL Length"), "rule_id", "urls_matched") == [(4, 0)]
    assert rows(reports.top_scores(seed), "url_id") == [(3,), (1,), (5,), (2,), (4,)]
    pairs = spark.createDataFrame([(1, 3), (1, 5)], "url_id bigint, user_id bigint")
    assert sorted(rows(reports.viewer_votes(seed, pairs))) == [(1, 3, 1), (1, 5, None)]
    assert rows(reports.feed_summary(seed, "nobody@x")) == [(0, None)]
    assert rows(reports.feed_summary(seed, "priya.nair@example.com")) == [(4, DAY)]
    assert rows(reports.status_text_search(seed, "CONFIRMED", "label"), "status_id") == [(1,), (3,)]


def test_jobs_that_select_nothing(seed):
    assert maintenance.reclassify_by_votes(seed, DAY).rows_affected() == 0
    assert maintenance.annotate_admin_statuses(seed).rows_affected() == 0
    assert maintenance.cleanup_rule_matches(seed).rows_affected() == 0
    assert maintenance.promote_users(seed).rows_affected() == 0


def test_reclassify_thresholds(spark, seed):
    votes = [(i, 100 + i, url, value, DAY) for i, (url, value) in enumerate(
        [(1, -1), (1, -1), (1, 1)]                       # mean -0.33: legitimate
        + [(2, 1)] * 13 + [(2, -1)] * 7                  # mean exactly 0.3: untouched
        + [(5, 1), (5, 1)]                               # too few
        + [(7, 1), (7, 1), (7, 1)]
    )]
    change = maintenance.reclassify_by_votes(seed.with_tables(votes=table(spark, "votes", votes)), DAY)
    got = {r.url_id: (r.result_code, r.updated_at) for r in change.tables.url_submissions.collect()}
    assert (got[1], got[7]) == (("LEGITIMATE", DAY), ("PHISHING", DAY))
    assert (got[2], got[5]) == (("LEGITIMATE", None), ("SUSPICIOUS", None))
    assert change.rows_affected() == 2


def test_recompute_scores(seed):
    change = maintenance.recompute_scores(seed)
    got = {r.url_id: (round(r.avg_score, 9), r.risk_level) for r in change.tables.url_score_comparisons.collect()}
    assert got == {1: (0.8, "critical"), 2: (0.0, "low"), 3: (0.925, "critical"), 4: (0.0, "low"), 5: (0.7, "high")}
    assert change.rows_affected() == 5


def test_recompute_scores_without_votes_is_null_and_low(seed):
    change = maintenance.recompute_scores(seed.with_tables(votes=seed.votes.where("url_id <> 1")))
    got = {r.url_id: (r.avg_score, r.risk_level) for r in change.tables.url_score_comparisons.collect()}
    assert got[1] == (None, "low")


def test_community_statuses(seed):
    assert maintenance.community_statuses(seed, DAY + timedelta(hours=1)).rows_affected() == 0
    change = maintenance.community_statuses(seed, DAY + timedelta(days=2))
    new = change.tables.statuses.where("status_id > 5").collect()
    assert [(r.status_id, r.url_id, r.reviewer_id, r.result_code, r.label) for r in new] == [
        (6, 1, 1, "PHISHING", "Community Confirmed Phishing")
    ]
    assert new[0].description == "Automated status update based on 2 community votes. Average vote: 1.0"


def test_admin_notes(spark, seed):
    votes = [(1, 3, 2, 1, DAY), (2, 4, 2, 1, DAY), (3, 3, 4, 1, DAY), (4, 4, 4, 1, DAY)]
    urls = seed.url_submissions.withColumn("result_code", F.when(F.col("url_id") != 4, F.col("result_code")))
    statuses = seed.statuses.withColumn("description", F.when(F.col("url_id") != 2, F.col("description")))
    t = seed.with_tables(votes=table(spark, "votes", votes), url_submissions=urls, statuses=statuses)
    change = maintenance.annotate_admin_statuses(t)
    got = {r.status_id: (r.result_code, r.description) for r in change.tables.statuses.collect()}
    assert got[2] == ("LEGITIMATE", None)
    assert got[4] == ("LEGITIMATE", "fourth" + maintenance.ADMIN_NOTE)
    assert got[1] == ("PHISHING", "first")
    assert rows(change.problems) == [(4, 4)]
    assert change.rows_affected() == 2


def test_cleanup_inactive_takes_scores_and_is_idempotent(spark, seed):
    scores = table(spark, "url_score_comparisons", [(9, 7, "x", 0.1, 0.1, "low", DAY), (10, 1, "x", 0.1, 0.1, "low", DAY)])
    t = seed.with_tables(url_score_comparisons=scores)
    assert maintenance.cleanup_inactive(t, DAY + timedelta(days=90)).rows_affected() == 0
    change = maintenance.cleanup_inactive(t, DAY + timedelta(days=91))
    assert sorted(rows(change.affected)) == [(7,), (10,)]
    assert rows(change.tables.url_score_comparisons, "rep_id") == [(10,)]
    assert maintenance.cleanup_inactive(change.tables, DAY + timedelta(days=91)).rows_affected() == 0


def test_cleanup_rule_matches_drops_orphans(spark, seed):
    extra = table(spark, "url_rule_matches", [(20, 99, 1, None, DAY), (21, 1, 99, None, DAY), (22, 2, 7, None, DAY), (23, 2, 8, None, DAY)])
    t = seed.with_tables(url_rule_matches=seed.url_rule_matches.unionByName(extra))
    change = maintenance.cleanup_rule_matches(t)
    assert sorted(rows(change.affected)) == [(20,), (21,), (22,)]
    assert change.tables.url_rule_matches.count() == 12
    assert maintenance.cleanup_rule_matches(change.tables).rows_affected() == 0
    got = {(r.table_name, r.check_name, r.column_names): r.violations for r in audit.integrity_audit(t).collect()}
    assert got["url_rule_matches", "reference", "url_id"] == 1
    assert got["url_rule_matches", "reference", "rule_id"] == 1
    assert sum(got.values()) == 2


def test_audit_counts_every_kind(spark, seed):
    t = seed.with_tables(
        users=seed.users.unionByName(table(spark, "users", [(6, "Eve", "priya.nair@example.com", "root", DAY)])),
        votes=seed.votes.unionByName(table(spark, "votes", [(9, 3, 1, 0, DAY)])),
        url_score_comparisons=seed.url_score_comparisons.withColumn("created_at", F.lit(None).cast("timestamp_ntz")),
    )
    got = {k: v for *k, v in map(tuple, audit.integrity_audit(t).collect()) for k in [tuple(k)] if v}
    assert got == {
        ("users", "unique", "email"): 1,
        ("users", "allowed", "role"): 1,
        ("votes", "unique", "user_id,url_id"): 1,
        ("votes", "allowed", "vote_value"): 1,
        ("url_score_comparisons", "required", "created_at"): 5,
    }
    assert not [r for r in audit.integrity_audit(seed).collect() if r.violations]


def test_promotion(spark, seed):
    urls = [(i, 3, f"http://h/{i}", "h", None, "PHISHING" if i < 5 else None, DAY, None) for i in range(10)]
    urls += [(20 + i, 2, f"http://g/{i}", "g", None, "PHISHING", DAY, None) for i in range(10)]
    urls += [(40 + i, 4, f"http://k/{i}", "k", None, "PHISHING" if i < 4 else None, DAY, None) for i in range(10)]
    change = maintenance.promote_users(seed.with_tables(url_submissions=table(spark, "url_submissions", urls)))
    assert dict(rows(change.tables.users, "user_id", "role")) == {1: "admin", 2: "analyst", 3: "analyst", 4: "user", 5: "user"}
    assert change.rows_affected() == 3


def test_auto_classify_modes(seed):
    pending = seed.with_tables(url_submissions=seed.url_submissions.withColumn("result_code", F.lit(None).cast("string")))
    default = {r.url_id: (r.result_code, r.updated_at) for r in maintenance.auto_classify(pending, DAY).tables.url_submissions.collect()}
    assert (default[1], default[3], default[5], default[2]) == (
        ("PHISHING", DAY), ("SUSPICIOUS", DAY), ("SUSPICIOUS", DAY), ("LEGITIMATE", DAY)
    )
    strict = {r.url_id: (r.result_code, r.updated_at) for r in maintenance.auto_classify(pending, DAY, True).tables.url_submissions.collect()}
    assert (strict[1], strict[2]) == (("PHISHING", None), (None, None))


def test_evaluate_rules(seed):
    hits = rules_engine.rule_hits(seed.url_submissions, seed.rules)
    got = {}
    for r in hits.collect():
        got.setdefault(r.url_id, set()).add(r.rule_id)
    assert got == {1: {1, 3, 7}, 2: {7}, 3: {1, 2}, 4: {1, 7}, 5: {8}, 6: {1, 3}, 8: {5}, 9: {1, 3}}
    several = rules_engine.rule_hits(seed.url_submissions, seed.rules, patterns_per_pass=2)
    assert sorted(several.collect()) == sorted(hits.collect())
    assert sorted(rows(rules_engine.evaluate_rules(seed), "url_id", "rule_id")) == [(2, 7), (4, 1), (4, 7)]


def test_link_named_rules_for_new_url(spark, seed):
    requests = spark.createDataFrame(
        [(1, 3, "https://secure-verify-account-update.tk/login", "PHISHING")], "seq bigint, user_id bigint, url string, result_code string"
    )
    stored = intake.store_submissions(seed, intake.submit_urls(seed, requests).accepted, DAY)
    assert rows(stored.affected) == [(11,)]
    links = intake.link_named_rules(stored.tables, stored.affected, ["Suspicious Keywords", "Suspicious TLD"], "verify", "auto")
    assert sorted(rows(links, "url_id", "rule_id")) == [(11, 1), (11, 3)]
    added = intake.store_matches(stored.tables, links, DAY)
    assert sorted(rows(added.tables.url_rule_matches.where("url_id = 11"), "match_id", "rule_id")) == [(12, 1), (13, 3)]


def test_add_rule_and_match(seed):
    rules, matches = intake.add_rule_and_match(seed)
    assert sorted(rows(matches, "url_id", "rule_id")) == [(i, 9) for i in range(1, 11)]
    assert rules.count() == 9
    again, _ = intake.add_rule_and_match(seed.with_tables(rules=rules))
    assert again.count() == 9


def test_delete_cascades(spark, seed):
    one = spark.createDataFrame([(1,)], "url_id bigint")
    left = intake.delete_submissions(seed, one).tables
    assert [getattr(left, n).count() for n in left.names()] == [5, 9, 8, 8, 4, 4, 4]
    user = spark.createDataFrame([(2,), (3,)], "user_id bigint")
    left = intake.delete_submissions(seed, user_ids=user).tables
    assert sorted(rows(left.url_submissions, "url_id")) == [(2,), (4,), (5,), (7,), (8,), (10,)]
    assert sorted(rows(left.statuses, "status_id", "reviewer_id")) == [(2, 1), (4, 1), (5, None)]
    rule = spark.createDataFrame([(1,)], "rule_id bigint")
    assert intake.delete_submissions(seed, rule_ids=rule).tables.url_rule_matches.count() == 7


def test_remove_matches(spark, seed):
    asked = spark.createDataFrame([(1, 1), (2, 3), (99, 1)], "match_id bigint, url_id bigint")
    change = intake.remove_rule_matches(seed, asked)
    assert change.rows_affected() == 1
    assert sorted(rows(change.problems, "match_id", "url_id")) == [(2, 3), (99, 1)]


def test_run_job(seed, spark):
    _, report = jobs.run_job(seed, "recompute_scores", DAY)
    assert rows(report) == [("recompute_scores", 5, "Recalculate blended risk scores complete. Rows affected: 5.")]
    with pytest.raises(ValueError, match="Unknown maintenance task"):
        jobs.run_job(seed, "nope", DAY)


def test_refresh_verdicts(seed):
    t = jobs.refresh_verdicts(seed, DAY)
    assert t.url_rule_matches.count() == 14
    assert t.url_score_comparisons.where("url_id = 4").first().risk_level == "medium"


def test_feed_user_once(seed):
    once = feed.ensure_feed_user(seed, DAY)
    assert rows(once.users.where("user_id = 6"), "name", "role") == [("URLHaus Feed", "analyst")]
    assert feed.ensure_feed_user(once, DAY).users.count() == 6
