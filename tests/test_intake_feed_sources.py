"""Intake, feed import, files and streams against step-by-step references."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import DAY, rows
from snarelight.operators import voting
from snarelight.plans import feed, intake
from snarelight.plans.search import export_rows
from snarelight.sources import export_csv, feed_csv, snapshots
from snarelight.streaming import jobs as streams
from test_operators import LOG, sequential_votes, vote_events

REQUEST = "seq bigint, user_id bigint, url string, result_code string"


def reasons(result):
    return {r.seq: r.reason for r in result.labelled().collect()}


def test_submit_reasons(spark, seed):
    cases = [
        (1, 3, "  http://new.example/a ", None, None),
        (2, 3, "http://new.example/a", None, "duplicate_url"),
        (3, 3, " ", None, "url_required"),
        (4, 3, "http://x/" + "a" * 2040, None, "invalid_characters"),
        (5, 3, "http://x/" + "a" * 2039, None, None),
        (6, 3, "http://x/;", None, "invalid_characters"),
        (7, 3, "http://x/\nb", None, "invalid_characters"),
        (8, None, "http://x/c", None, "not_signed_in"),
        (9, 0, "http://x/c", None, "not_signed_in"),
        (10, 77, "http://x/c", None, "unknown_user"),
        (11, 3, "http://[x", None, "malformed_host"),
        (12, 3, "https://bit.ly/suspicious-link-xyz", None, "duplicate_url"),
        (13, 4, "http://x/c", "PHISHING", None),
    ]
    requests = spark.createDataFrame([c[:4] for c in cases], REQUEST)
    result = intake.submit_urls(seed, requests)
    assert reasons(result) == {c[0]: c[4] for c in cases}
    stored = {r.seq: r for r in result.accepted.collect()}
    assert (stored[1].url, stored[1].scheme, stored[1].result_code) == ("http://new.example/a", "http", "SUSPICIOUS")
    assert stored[13].result_code == "PHISHING"


def test_register_reasons(spark, seed):
    cases = [
        (1, "A", "a@x", "name_too_short", None),
        (2, " Al ", "al.x", "invalid_email", None),
        (3, "Al", "a@" + "x" * 254, "invalid_email", None),
        (4, "Al", "priya.nair@example.com", "email_taken", None),
        (5, "Al", "Priya.Nair@example.com", None, True),
        (6, "Al", " new@x ", None, False),
        (7, "Bo", "new@x", "email_taken", None),
    ]
    result = intake.register_users(seed, spark.createDataFrame([c[:3] for c in cases], "seq bigint, name string, email string"))
    assert reasons(result) == {c[0]: c[3] for c in cases}
    assert dict(rows(result.accepted, "seq", "case_variant")) == {5: True, 6: False}


def test_add_match_reasons(spark, seed):
    cases = [(1, 2, 1, " x " * 300, None), (2, 2, 1, "", "already_applied"), (3, 1, 1, "", "already_applied"), (4, 99, 1, "", "unknown_url"), (5, 2, 99, "", "unknown_rule"), (6, 2, 3, " ", None)]
    result = intake.add_rule_matches(seed, spark.createDataFrame([c[:4] for c in cases], "seq bigint, url_id bigint, rule_id bigint, match_details string"))
    assert reasons(result) == {c[0]: c[4] for c in cases}
    notes = dict(rows(result.accepted, "seq", "match_details"))
    assert len(notes[1]) == 500 and notes[6] is None


FEED = "seq bigint, url string, dateadded string, threat string, url_status string, tags string, last_online string"


def feed_rows_sample(count):
    rng = random.Random(4)
    pick = lambda *options: rng.choice(options)
    return [
        (i, pick(" ", "https://bit.ly/suspicious-link-xyz", *[f" http://h{n}.test/x" for n in range(60)]), pick(None, "", "2024-02-01 10:00:00"),
         pick("", None, "malware ", "  "), pick(None, " online ", "  ", ""), pick("a,b", "", "  ", None), pick(None, "", "2024-02-03 00:00:00"))
        for i in range(count)
    ]


def import_step_by_step(stored, feed_file, limit):
    inserted, skipped = {}, 0
    for seq, url, added, threat, status, tags, seen in feed_file:
        if limit and len(inserted) >= limit:
            break
        url = (url or "").strip()
        if not url:
            continue
        if url in stored or url in inserted:
            skipped += 1
            continue
        threat = (threat or "Threat").strip()
        status = (status or "unknown").strip() or "unknown"
        tags = (tags or "n/a").strip() or "n/a"
        when = lambda t: datetime.fromisoformat(t) if t else DAY
        inserted[url] = (seq, when(added), f"URLHaus: {threat}", f"Status: {status}; Tags: {tags}; Last seen: {seen or 'n/a'}.", when(seen or added))
    return inserted, skipped


@pytest.mark.parametrize("limit", [0, 1, 25, 250])
def test_feed_import_equals_loop(spark, seed, limit):
    sample = feed_rows_sample(200)
    known = {r.url for r in seed.url_submissions.collect()}
    expected, skipped = import_step_by_step(known, sample, limit)
    result = feed.feed_import(seed, spark.createDataFrame(sample, FEED), DAY, limit)
    got = {r.url: (r.seq, r.created_at, r.label, r.description, r.reviewed_at) for r in result.inserted.collect()}
    assert got == expected
    assert rows(result.summary) == [(len(expected), skipped)]


def test_feed_twice_adds_nothing(spark, seed):
    sample = spark.createDataFrame(feed_rows_sample(200), FEED)
    first = feed.feed_import(seed, sample, DAY, 0).inserted
    stored = feed.store_feed(seed, first, DAY).tables
    assert stored.url_submissions.count() == 10 + first.count() == stored.statuses.count() + 5
    assert stored.url_submissions.where("user_id = 6").count() == first.count()
    assert feed.feed_import(stored, sample, DAY, 0).inserted.count() == 0
    feed_review = stored.statuses.where("status_id = 6").first()
    assert feed_review.url_id == 11 and feed_review.reviewer_id is None


def test_feed_files_keep_line_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,dateadded,url,threat,tags\n1,2024-01-01,"http://q/""x""",t,"a,b"\n2,,http://r/,"two\nlines",\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("id,dateadded,url,threat,tags\n3,,http://s/,,x\n", encoding="utf-8")
    got = rows(feed_csv.read_feed(spark, str(tmp_path)).orderBy("seq"), "seq", "url", "threat", "tags", "last_online")
    assert got == [
        (0, 'http://q/"x"', "t", "a,b", None),
        (1, "http://r/", "two\nlines", None, None),
        (2, "http://s/", None, "x", None),
    ]


def test_export_bytes(spark, seed, tmp_path):
    odd = seed.url_submissions.where("url_id = 3").withColumn("url", F.lit('http://a/"b", c '))
    out = str(tmp_path / "out")
    export_csv.write_csv(export_rows(seed.with_tables(url_submissions=odd)), out, single_file=True)
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert part.read_bytes() == (
        b"URL,Domain,TLD,Status,Submitter,Submitted,Phishing votes,Legitimate votes\r\n"
        b'"http://a/""b"", c ",192.168.1.100,,PHISHING,Priya Nair,2024-03-01 09:00:00,1,0\r\n'
    )


def test_snapshots_switch_and_remember_ids(spark, seed, tmp_path):
    root = str(tmp_path / "store")
    assert snapshots.save(seed, root) == 1
    tables, ids = snapshots.load(spark, root)
    assert ids["votes"] == 6
    fewer = tables.with_tables(votes=tables.votes.where("vote_id < 6"))
    assert snapshots.save(fewer, root, ["votes"]) == 2
    tables, ids = snapshots.load(spark, root)
    assert tables.votes.count() == 5 and ids["votes"] == 6
    assert tables.users.count() == 5
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, str(tmp_path / "empty"))


def file_stream(spark, folder, data, schema, cuts):
    """Rows written as one parquet file per cut, streamed one file per batch in that order."""
    import os
    import time

    bounds = [0, *cuts, len(data)]
    stamp = time.time() - 1000
    for n, (low, high) in enumerate(zip(bounds, bounds[1:])):
        part = f"{folder}/in/{n}"
        spark.createDataFrame(data[low:high], schema).coalesce(1).write.parquet(part)
        for name in os.listdir(part):
            os.utime(f"{part}/{name}", (stamp + n * 10, stamp + n * 10))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_streamed_votes_equal_batch(spark, tmp_path):
    events = sorted(vote_events(11, 300), key=lambda e: (e[1], e[0]))
    stream = file_stream(spark, tmp_path, events, LOG, [80, 81, 200])
    out = str(tmp_path / "out")
    streams.stream_votes(stream, out).awaitTermination()
    got = {(r.user_id, r.url_id): (r.vote_value, r.created_at) for r in streams.current_votes(spark, out).collect()}
    assert got == sequential_votes(events)
    assert streams._summaries(spark, out).spans() == {(n, n + 1) for n in range(4)}
    assert spark.read.parquet(f"{out}/rejected").count() == sum(e[4] == 0 for e in events)
    earlier = vote_events(12, 120)
    stored = voting.fold_votes(spark.createDataFrame(earlier, LOG))
    moved = [(e[0], e[1] - timedelta(days=1), *e[2:]) for e in earlier]
    on_top = streams.current_votes(spark, out, stored)
    expected = {k: v[0] for k, v in sequential_votes(moved + [(e[0] + 1000, *e[1:]) for e in events]).items()}
    assert {(r.user_id, r.url_id): r.vote_value for r in on_top.collect()} == expected


def test_streamed_submissions_equal_batch(spark, seed, tmp_path):
    rng = random.Random(3)
    data = [(i, 3, f"http://h{rng.randrange(40)}.tk/verify", None) for i in range(120)]
    stream = file_stream(spark, tmp_path, data, REQUEST, [30, 90])
    out = str(tmp_path / "out")
    streams.stream_submit(stream, seed, out).awaitTermination()
    batch = intake.submit_urls(seed, spark.createDataFrame(data, REQUEST))
    assert sorted(rows(spark.read.parquet(f"{out}/accepted"), "seq")) == sorted(rows(batch.accepted, "seq"))
    assert sorted(rows(spark.read.parquet(f"{out}/rejected"), "seq")) == sorted(rows(batch.rejected, "seq"))
    hits = spark.read.parquet(f"{out}/hits")
    assert hits.count() == 2 * batch.accepted.count()


def test_streamed_feed_equals_batch(spark, seed, tmp_path):
    sample = feed_rows_sample(150)
    out = str(tmp_path / "out")
    streams.stream_feed(file_stream(spark, tmp_path, sample, FEED, [50, 100]), seed, out, DAY).awaitTermination()
    batch = feed.feed_import(seed, spark.createDataFrame(sample, FEED), DAY, 0).inserted
    assert sorted(rows(spark.read.parquet(f"{out}/accepted"), "seq", "url")) == sorted(rows(batch, "seq", "url"))
