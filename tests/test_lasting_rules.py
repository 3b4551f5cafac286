"""Large catalogues, ids that are never given out again, hosts, feed headers and competing snapshots."""

import pytest
from helpers import DAY, rows, table
from pyspark.sql import functions as F

from snarelight.functions.urls import malformed_host
from snarelight.plans import feed, intake, jobs, maintenance, reports, rules_engine, search
from snarelight.sources import feed_csv, snapshots


def many_rules(spark, count, kind="tld"):
    data = [(i, f"Rule {i:05}", None, f"host{i}.example", kind, "low", f".t{i}") for i in range(1, count + 1)]
    return table(spark, "rules", data)


def test_available_rules_of_a_large_catalogue_equal_the_anti_join(seed, spark):
    t = seed.with_tables(rules=many_rules(spark, 2500))
    asked = t.url_submissions.where("url_id <= 5").select("url_id")
    got = search.available_rules(t, asked).collect()
    taken = {tuple(r) for r in t.url_rule_matches.select("url_id", "rule_id").collect()}
    assert sorted(r.url_id for r in got) == [1, 2, 3, 4, 5]
    for r in got:
        assert [x.rule_id for x in r.available_rules] == [i for i in range(1, 2501) if (r.url_id, i) not in taken]
        assert r.available_count == len(r.available_rules)


def test_risk_rankings_cut_ties_alike(seed, spark, monkeypatch):
    scores = [(i, 1 + i % 3, "x", s, None, level, DAY) for i, (s, level) in enumerate([(None, "low"), (0.5, "low"), (0.5, None)] * 5)]
    t = seed.with_tables(url_score_comparisons=table(spark, "url_score_comparisons", scores))
    for limit in (1, 2, 3, 5):
        few = rows(reports.risk_rankings(t, limit))
        with monkeypatch.context() as m:
            m.setattr(reports, "BROADCAST_ROWS", 0)
            assert rows(reports.risk_rankings(t, limit)) == few


def test_rule_ids_are_not_given_out_again(seed):
    left = intake.delete_submissions(seed, rule_ids=seed.rules.where("rule_id = 8").select("rule_id")).tables
    rules, matches = intake.add_rule_and_match(left)
    assert rules.agg(F.max("rule_id")).first()[0] == 9
    assert {r.rule_id for r in matches.collect()} == {9}


def test_user_url_match_and_status_ids_are_not_given_out_again(seed, spark):
    gone = seed.users.where("user_id = 5").select("user_id")
    left = intake.delete_submissions(seed, user_ids=gone).tables
    assert left.url_submissions.agg(F.max("url_id")).first()[0] == 9
    users = feed.ensure_feed_user(left, DAY).users
    assert users.agg(F.max("user_id")).first()[0] == 6
    accepted = spark.createDataFrame([(1, 3, "http://n.example/", "n.example", ".example", "PHISHING")],
                                     "seq bigint, user_id bigint, url string, url_domain string, tld string, result_code string")
    stored = intake.store_submissions(left, accepted, DAY).tables.url_submissions
    assert stored.agg(F.max("url_id")).first()[0] == 11
    removed = intake.remove_rule_matches(left, left.url_rule_matches.where("match_id = 11").select("match_id", "url_id")).tables
    match = spark.createDataFrame([(2, 5, "x")], "url_id bigint, rule_id bigint, match_details string")
    assert intake.store_matches(removed, match, DAY).tables.url_rule_matches.agg(F.max("match_id")).first()[0] == 12
    assert left.last_ids["statuses"] == 5
    cleaned = maintenance.cleanup_rule_matches(left).tables
    assert cleaned.last_ids["url_rule_matches"] == 11


def test_jobs_continue_from_a_snapshots_marks(seed, spark, tmp_path):
    root = str(tmp_path / "store")
    snapshots.save(seed, root)
    snapshots.save(intake.delete_submissions(seed, url_ids=seed.url_submissions.where("url_id = 10").select("url_id")).tables, root)
    tables, _ = snapshots.load(spark, root)
    rows_ = spark.createDataFrame([(1, "http://f.example/a", None, "t", None, None, None)], "seq bigint, url string, dateadded string, threat string, url_status string, tags string, last_online string")
    change, _ = jobs.run_job(tables, "import_urlhaus", DAY, rows_)
    assert [r.url_id for r in change.affected.collect()] == [11]


def test_rules_by_type(spark, seed):
    urls = spark.createDataFrame(
        [(1, "http://host7.example/a", "host7.example", ".t9"), (2, "http://x/" + "y" * 90, "x", None), (3, "http://HOST/login", "host", ".t9")],
        "url_id bigint, url string, url_domain string, tld string",
    )
    rules = table(spark, "rules", [
        (1, "a", None, "HOST7.example", "domain", "low", None), (2, "b", None, None, "tld", "low", ".t9"), (3, "c", None, None, "length", "low", None),
        (4, "d", None, "(", "regex", "low", None), (5, "e", None, "LOGIN", "keyword", "low", None), (6, "f", None, None, "tld", "low", ".t9"),
        (7, "g", None, "x", "other", "low", None), (8, "h", None, None, "regex", "low", None), (9, "i", None, None, "tld", "low", None),
    ])
    got = sorted((r.url_id, r.rule_id) for r in rules_engine.rule_hits(urls, rules).collect())
    assert got == [(1, 1), (1, 2), (1, 6), (2, 3), (3, 2), (3, 5), (3, 6)]
    assert rows(rules_engine.bad_patterns(rules)) == [(4, "(")]


def test_tld_and_domain_rules_add_no_plan(spark, seed):
    text = lambda rules: rules_engine.rule_hits(seed.url_submissions, rules)._jdf.queryExecution().analyzed().toString()
    few, many = text(many_rules(spark, 10)), text(many_rules(spark, 10_000))
    assert len(many) < 1.1 * len(few) + 1000
    domains = rules_engine.rule_hits(seed.url_submissions, many_rules(spark, 10_000, "domain"))
    assert domains.count() == 0


HOSTS = {
    "http://[::1]/x": False, "http://[::1]:80/": False, "http://u:p@[2001:db8::7]:1": False, "http://[1:2:3:4:5:6:7:8]": False,
    "http://[::ffff:1.2.3.4]/": False, "http://[v1.fe]/": False, "http://[fe80::1%eth0]/": False, "http://plain/[x]": False, "no host [": False,
    "http://[abc]/x": True, "http://[bad/x": True, "http://bad]/x": True, "http://[]/": True, "http://a[::1]/": True, "http://[::1]x/": True,
    "http://[1.2.3.4]/": True, "http://[1:2:3]/": True, "http://[::1::2]/": True, "http://[12345::]/": True, "http://[v.fe]/": True,
}


def test_hosts_in_brackets(spark):
    df = spark.createDataFrame([(u,) for u in HOSTS], "url string")
    assert {r.url: r.bad for r in df.withColumn("bad", malformed_host(F.col("url"))).collect()} == HOSTS


def test_malformed_feed_urls_are_rejected(seed, spark):
    columns = "seq bigint, url string, dateadded string, threat string, url_status string, tags string, last_online string"
    data = [(i, u, None, None, None, None, None) for i, u in enumerate(["http://[bad/x", "http://ok.example/", " ", "http://[abc]/x"])]
    got = feed.feed_import(seed, spark.createDataFrame(data, columns), DAY, 0)
    assert [r.url for r in got.inserted.collect()] == ["http://ok.example/"]
    assert sorted(r.seq for r in got.rejected.collect()) == [0, 3]


def test_each_feed_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('url,dateadded,threat\n"http://a/","2024-01-01","x, ""y"""\n')
    (tmp_path / "b.csv").write_text('dateadded,tags,url\n2024-01-02,t,http://b/\n2024-01-03,,http://c/\n')
    (tmp_path / "c.csv").write_text('url,tags\nhttp://d/,"two\nlines"\n')
    got = rows(feed_csv.read_feed(spark, str(tmp_path)).orderBy("seq"), "seq", "url", "dateadded", "tags", "threat")
    assert got == [
        (0, "http://a/", "2024-01-01", None, 'x, "y"'), (1, "http://b/", "2024-01-02", "t", None),
        (2, "http://c/", "2024-01-03", None, None), (3, "http://d/", None, "two\nlines", None),
    ]


def test_the_later_of_two_runs_fails(seed, spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    snapshots.save(seed, root)
    before = snapshots._latest(spark, root)
    fewer = seed.with_tables(votes=seed.votes.where("vote_id < 3"))
    assert snapshots.save(fewer, root, ["votes"]) == 2
    with monkeypatch.context() as m:
        m.setattr(snapshots, "_latest", lambda spark, root: before)  # started from version 1 as well
        with pytest.raises(snapshots.ConcurrentChange):
            snapshots.save(seed.with_tables(votes=seed.votes.where("vote_id > 4")), root, ["votes"])
    assert [r.vote_id for r in snapshots.load(spark, root)[0].votes.orderBy("vote_id").collect()] == [1, 2]
