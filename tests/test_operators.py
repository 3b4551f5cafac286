"""Building blocks against brute force on small data."""

import os
import random
from datetime import datetime, timedelta
from urllib.parse import urlparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import rows
from snarelight.functions import text, urls, verdicts
from snarelight.operators import sessions, voting
from snarelight.operators.catalogue import with_catalogue
from snarelight.operators.topk import top_rows
from snarelight.operators.positions import with_group_positions, with_index, with_new_ids, with_rank
from snarelight.operators.skew import expand_join, is_small, lookup_join
from snarelight.session import stored, temporary_folders

START = datetime(2024, 1, 1)
EDGE_URLS = [
    "http://example.com/path", "example.com/path", "HTTPS://User:Pw@WWW.Example.COM:8080/x?y#z", "http://192.168.1.100/x",
    "http://x.com./a", "http://[::1]:80/", "http://[FE80::1%EN0]/", "http://A%2FB.com/", "//Foo.bar:9", "http://", "http:///path",
    "http://user@/p", "http://a@b@c.d/", "mailto:x@y.z", "http://a_b.example.com", "http://%zz/", "ht tp://x.y",
    "http://ex ample.com/q", " http://lead.com", "http://new\nline.com/", "http://tab\there.com", "http://host?x@y.z",
    "http://host#a@b", "1http://x.y/", "a:b", "http://x.com:/", "http://:80/", "foo", "", "http://x..y", "http://.", "//",
]


def python_parts(url):
    host = urlparse(url).hostname or url
    return host, "." + host.split(".")[-1] if "." in host else None


def spark_parts(spark, found):
    df = urls.with_url_parts(spark.createDataFrame([(u,) for u in found], "url string"))
    return {r.url: (r.url_domain, r.tld) for r in df.collect()}


def test_url_parts_on_edge_cases(spark):
    assert spark_parts(spark, EDGE_URLS) == {u: python_parts(u) for u in EDGE_URLS}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="aB.:/@?#%-_ 1\t", min_size=0, max_size=14).map(lambda t: "http://" + t), min_size=200, max_size=400))
def test_url_parts_on_random_text(spark, found):
    assert spark_parts(spark, found) == {u: python_parts(u) for u in found}


def test_text_helpers(spark):
    df = spark.createDataFrame([(" \u2003x\n",), ("  ",), ("",), (None,)], "t string")
    assert rows(df.select(text.strip("t"))) == [("x",), ("",), ("",), (None,)]
    assert rows(df.select(text.strip_or(F.col("t"), "d"))) == [("x",), ("",), ("d",), ("d",)]
    assert rows(df.select(text.code_label(F.col("t")))) == [(" \u2003x\n",), ("  ",), ("UNKNOWN",), ("UNKNOWN",)]
    pct = spark.createDataFrame([(12.345,), (None,)], "p double").select(text.percent_text(F.col("p")))
    assert rows(pct) == [("12.35%",), ("0.00%",)]
    when = spark.createDataFrame([(START,)], "t timestamp_ntz").select(text.minute_text(F.col("t")))
    assert rows(when) == [("2024-01-01 00:00",)]


def test_average_boundaries_are_strict(spark):
    df = spark.createDataFrame([(0.5,), (0.51,), (-0.5,), (-0.51,), (None,)], "a double")
    got = df.select(verdicts.by_average(F.col("a"), 0.5, ("up", "down", "mid"))).collect()
    assert [r[0] for r in got] == ["mid", "up", "mid", "down", "mid"]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows on one key, a third without key, the rest spread."""
    keys = [7] * 300 + [None] * 300 + list(range(300))
    many = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "row_id bigint, k bigint")
    one = spark.createDataFrame([(k, f"n{k}") for k in range(0, 400, 2)] + [(7, "n7")], "k bigint, name string")
    return many.cache(), one.cache()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [10, 100_000])
def test_lookup_join_equals_plain_join(skewed, how, hot_rows):
    many, one = skewed
    plain = many.join(one, ["k"], how)
    split = lookup_join(many, one, ["k"], how, ["row_id"], small=False, hot_rows=hot_rows)
    order = lambda df: sorted(map(str, df.select(*plain.columns).collect()))
    assert order(split) == order(plain)


def test_hot_key_is_spread_over_tasks(spark, skewed):
    many, one = skewed
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup_join(many, one, ["k"], "left", ["row_id"], small=False, hot_rows=10)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 8
    assert max(r["count"] for r in sizes) < 300


@pytest.mark.parametrize("hot_rows", [10, 100_000])
def test_expand_join_equals_left_join(skewed, hot_rows):
    many, one = skewed
    plain = one.join(many, ["k"], "left").select("k", "name", "row_id")
    split = expand_join(one, many, ["k"], ["row_id"], small=False, hot_rows=hot_rows).select("k", "name", "row_id")
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))


def test_size_check(spark):
    assert is_small(spark.range(10), 10)
    assert not is_small(spark.range(11), 10)


def test_positions(spark):
    shuffled = random.Random(5).sample(range(5000), 5000)
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"g{i % 60}") for i in shuffled], "id bigint, g string").repartition(7)
    assert sorted(rows(with_index(df, [F.desc("id")], "n"), "id", "n")) == [(i, 4999 - i) for i in range(5000)]
    assert sorted(rows(with_new_ids(df, [F.asc("id")], "new", 100), "id", "new")) == [(i, i + 101) for i in range(5000)]
    expected, groups = {}, {}
    for i in sorted(shuffled, reverse=True):
        groups.setdefault("hot" if i % 3 else f"g{i % 60}", []).append(i)
    for members in groups.values():
        expected |= {i: (n + 1, len(members)) for n, i in enumerate(members)}
    for small in (True, False):
        got = with_group_positions(df, "g", [F.desc("id")], "p", "t", small)
        assert {r.id: (r.p, r.t) for r in got.collect()} == expected


def test_rank_with_ties(spark):
    values = [random.Random(i).randrange(40) / 10 for i in range(2000)]
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, score double")
    expected = {i: 1 + sum(w > v for w in values) for i, v in enumerate(values)}
    assert {r.id: r.r for r in with_rank(df, "score", "r").collect()} == expected


def test_catalogue_has_one_shape_at_every_size(spark):
    for size in (0, 23, 2500):
        rules = spark.createDataFrame([(f"r{i:04}", i) for i in range(size)], "name string, rule_id bigint")
        got = with_catalogue(spark.range(3), rules, "c").collect()
        assert len(got) == 3
        assert all([e["rule_id"] for e in r.c] == list(range(size)) for r in got)


def test_top_rows_above_the_bound_are_the_same(spark):
    df = spark.range(0, 5000, 1, 7).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(50)))
    order = [F.desc("k"), F.col("id").asc()]
    few = rows(top_rows(df, order, 1234).orderBy(*order))
    assert len(few) == 1234 and few == rows(top_rows(df, order, 1234, one_task_rows=10).orderBy(*order))


def sequential_votes(events):
    standing = {}
    for event_id, ts, user, url, value in sorted(events, key=lambda e: (e[1], e[0])):
        if value not in (-1, 1):
            continue
        if standing.get((user, url), (None,))[0] == value:
            del standing[user, url]
        else:
            standing[user, url] = (value, ts)
    return standing


def vote_events(seed, count):
    rng = random.Random(seed)
    return [
        (i, START + timedelta(seconds=rng.randrange(200)), 0 if i % 3 == 0 else rng.randrange(4), 0 if i % 3 == 0 else rng.randrange(3), rng.choice([-1, 1, 1, 1, 0]))
        for i in range(count)
    ]


LOG = "event_id bigint, ts timestamp_ntz, user_id bigint, url_id bigint, vote_value int"


@pytest.mark.parametrize("seed_number", [1, 2, 3])
def test_fold_votes_equals_sequential_fold(spark, seed_number):
    events = vote_events(seed_number, 900)
    got = {(r.user_id, r.url_id): (r.vote_value, r.created_at) for r in voting.fold_votes(spark.createDataFrame(events, LOG)).collect()}
    assert got == sequential_votes(events)


def test_summaries_combine_in_any_cut(spark):
    """A log cut at arbitrary points folds to the same votes, also on top of stored ones."""
    events = sorted(vote_events(9, 400), key=lambda e: (e[1], e[0]))
    df = spark.createDataFrame([(*e, n // 7) for n, e in enumerate(events)], LOG + ", segment int")
    summaries = voting.summarise_segments(voting.valid_votes(df))
    got = voting.standing_votes(voting.combine_segments(summaries))
    expected = sequential_votes(events)
    assert {(r.user_id, r.url_id): (r.vote_value, r.created_at) for r in got.collect()} == expected
    first = voting.fold_votes(df.where("segment < 20").drop("segment"))
    rest = voting.summarise_log(df.where("segment >= 20").drop("segment")).withColumn("segment", F.lit(1))
    both = rest.unionByName(voting.as_summaries(first).withColumn("segment", F.lit(0)))
    got = voting.standing_votes(voting.combine_segments(both))
    assert {(r.user_id, r.url_id): (r.vote_value, r.created_at) for r in got.collect()} == expected


def test_sessions_at_the_boundary(spark):
    hours = [0, 8, 15.999, 24.5, 33, 41]
    events = [(1, START + timedelta(hours=h)) for h in hours] + [(2, START), (2, START + timedelta(hours=8, microseconds=1))]
    got = rows(sessions.user_sessions(spark.createDataFrame(events, "user_id bigint, ts timestamp_ntz")), "user_id", "session_start", "event_count")
    assert sorted(got) == [
        (1, START, 3),
        (1, START + timedelta(hours=24.5), 1),
        (1, START + timedelta(hours=33), 2),
        (2, START, 1),
        (2, START + timedelta(hours=8, microseconds=1), 1),
    ]


def test_temporary_folders_are_removed(spark):
    with temporary_folders(spark):
        df = stored(spark.range(5), "kept")
        folder = df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
        assert df.count() == 5 and os.path.isdir(folder.replace("///", "/"))
    assert not os.path.exists(folder.replace("///", "/"))
