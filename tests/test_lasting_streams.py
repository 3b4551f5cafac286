"""Streams over many batches, stores by levels, open sessions, and snapshots of competing runs."""

import random
import re
import threading
from datetime import datetime, timedelta

import pytest
from helpers import DAY, rows, table
from pyspark.sql import functions as F
from test_intake_feed_sources import REQUEST, file_stream
from test_operators import LOG, sequential_votes, vote_events

from snarelight.operators.sessions import user_sessions
from snarelight.plans import intake, maintenance
from snarelight.sources import snapshots
from snarelight.streaming import jobs as streams
from snarelight.streaming.known import KnownUrls
from snarelight.streaming.levels import LevelStore


def numbers(spark, values):
    return spark.createDataFrame([(v,) for v in values], "n bigint")


def test_levels_stay_few_and_hold_all_rows(spark, tmp_path):
    store = LevelStore(spark, str(tmp_path / "store"), "n bigint", lambda rows_: rows_.select("n"), fan=2)
    for batch in range(7):
        store.compact(batch)
        before = store.spans()
        store.compact(batch)  # a batch that runs again finds what it left
        assert store.spans() == before
        if batch != 3:  # one without rows
            store.write(numbers(spark, [batch, batch]), batch)
            store.write(numbers(spark, [batch]), batch)
        assert len(store.cover(0, batch + 1)) <= 5
        assert sorted(rows(store.read(batch), "n")) == [(b,) for b in range(batch) if b != 3]
    assert sorted(rows(store.read(), "n")) == [(b,) for b in range(7) if b != 3]
    assert len(store.spans()) < 7


def test_half_written_segments_are_not_read(spark, tmp_path):
    store = LevelStore(spark, str(tmp_path / "store"), "n bigint", lambda rows_: rows_.select("n"), fan=2)
    for batch in range(2):
        store.write(numbers(spark, [batch]), batch)
    numbers(spark, [99]).write.parquet(store._folder((0, 2)))
    (tmp_path / "store" / "segment=0" / "upto=2" / "_SUCCESS").unlink()
    assert sorted(rows(store.read(), "n")) == [(0,), (1,)]
    store.compact(2)
    assert sorted(rows(store.read(), "n")) == [(0,), (1,)] and (0, 2) in store.spans()


def test_lookups_read_only_their_buckets(spark, tmp_path):
    url = lambda i: f"http://h{i}.example/"
    urls = lambda ids: spark.createDataFrame([(url(i),) for i in ids], "url string")
    known = KnownUrls(spark, str(tmp_path / "known"), buckets=16, fan=2)
    known.start(urls(range(200)))
    known.start(urls(range(1000, 1001)))  # the second start of a stream changes nothing
    for batch in range(5):
        known.added.compact(batch)
        known.add(urls(range(200 + 20 * batch, 220 + 20 * batch)), batch)
        # A batch that runs again doesn't meet its own URLs.
        assert rows(known.among(urls([200 + 20 * batch]), batch)) == []
    asked = urls([3, 215, 299, 300, 1000])
    assert sorted(rows(known.among(asked, 5))) == sorted((url(i),) for i in (3, 215, 299))
    one = urls([215])
    buckets = {re.search(r"bucket=(\d+)", f).group(1) for f in known.stored(one, 5).inputFiles()}
    assert buckets == {str(known._keyed(one).first().bucket)}
    assert rows(known.among(urls([]), 5)) == []


def test_submissions_over_many_batches_equal_one(spark, seed, tmp_path):
    rng = random.Random(5)
    taken = [r.url for r in seed.url_submissions.collect()]
    data = [(i, 3, rng.choice([*taken, " ", f"http://h{rng.randrange(60)}.tk/verify"]), None) for i in range(140)]
    out = str(tmp_path / "out")
    stream = file_stream(spark, tmp_path, data, REQUEST, range(28, 140, 28))
    streams.stream_submit(stream, seed, out, buckets=4, fan=2).awaitTermination()
    batch = intake.submit_urls(seed, spark.createDataFrame(data, REQUEST))
    for kind in ("accepted", "rejected"):
        want = getattr(batch, kind)
        assert sorted(rows(spark.read.parquet(f"{out}/{kind}"), "seq")) == sorted(rows(want, "seq"))
    assert spark.read.parquet(f"{out}/accepted").select("batch").distinct().count() > 3


def test_late_votes_are_listed_and_the_others_folded_by_time(spark, tmp_path):
    rng = random.Random(9)
    events = vote_events(11, 400)
    # Arrival: by time, some up to three times the delay late.
    arrival = sorted(events, key=lambda e: (e[1] + timedelta(seconds=rng.choice([0, 0, 0, 10, 25, 90])), e[0]))
    cuts = list(range(80, 400, 80))
    delay = timedelta(seconds=30)
    out = str(tmp_path / "out")
    streams.stream_votes(file_stream(spark, tmp_path, arrival, LOG, cuts), out, delay=delay, fan=2).awaitTermination()
    newest, late, kept = None, [], []
    for low, high in zip([0, *cuts], [*cuts, len(arrival)], strict=True):
        part = [e for e in arrival[low:high] if e[4] in (1, -1)]
        for e in part:
            (late if newest and e[1] < newest - delay else kept).append(e)
        newest = max([e[1] for e in part] + ([newest] if newest else []))
    assert late and sorted(r[0] for r in rows(spark.read.parquet(f"{out}/late"), "event_id")) == sorted(e[0] for e in late)
    got = {(r.user_id, r.url_id): (r.vote_value, r.created_at) for r in streams.current_votes(spark, out).collect()}
    assert got == sequential_votes(sorted(kept, key=lambda e: (e[1], e[0])))
    assert len(streams._summaries(spark, out).cover(0, 5)) <= 2
    waiting = spark.read.parquet(f"{out}/waiting")
    assert sorted({r[0] for r in rows(waiting, "batch")}) == [3, 4]
    assert waiting.where("batch = 4").agg(F.min("ts")).first()[0] >= newest - delay


def test_a_vote_batch_that_runs_again_changes_nothing(spark, tmp_path):
    events = sorted(vote_events(4, 200), key=lambda e: (e[1], e[0]))
    stream = file_stream(spark, tmp_path, events, LOG, [70, 140])
    out, handled = str(tmp_path / "out"), []
    plain = streams._start

    def twice(stream_, handle, out_, trigger=None):
        def again(batch, number):
            handle(batch, number)
            handled.append(number)
            handle(batch, number)

        return plain(stream_, again, out_, trigger)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(streams, "_start", twice)
        streams.stream_votes(stream, out, fan=2).awaitTermination()
    assert handled == [0, 1, 2]
    got = {(r.user_id, r.url_id): (r.vote_value, r.created_at) for r in streams.current_votes(spark, out).collect()}
    assert got == sequential_votes(events)


def test_open_and_closed_sessions_are_all_sessions(spark, tmp_path):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    data = sorted([(rng.randrange(6), start + timedelta(minutes=rng.randrange(12_000))) for _ in range(120)], key=lambda e: e[1])
    schema, out = "user_id bigint, ts timestamp_ntz", str(tmp_path / "out")
    streams.stream_sessions(file_stream(spark, tmp_path, data, schema, [40, 90]), out).awaitTermination()
    still_open = streams.open_sessions(spark, out)
    closed = spark.read.schema(still_open.schema).parquet(f"{out}/sessions")
    want = user_sessions(spark.createDataFrame(data, schema)).select(*still_open.columns)
    assert 0 < still_open.count() < want.count()
    assert sorted(rows(closed.unionByName(still_open))) == sorted(rows(want))


def votes_where(tables, condition):
    return tables.with_tables(votes=tables.votes.where(condition))


def test_one_of_two_concurrent_runs_wins(seed, spark, tmp_path):
    root = str(tmp_path / "store")
    snapshots.save(seed, root)
    for turn in range(2):
        base, _ = snapshots.load(spark, root)
        gate, outcomes = threading.Barrier(3), []

        def run(n, base=base, gate=gate, outcomes=outcomes, turn=turn):
            gate.wait()
            try:
                added = table(spark, "votes", [(1000 + 10 * turn + n, 3, 7, 1, DAY)])
                outcomes.append(snapshots.save(base.with_tables(votes=base.votes.unionByName(added)), root, ["votes"]))
            except snapshots.ConcurrentChange as lost:
                outcomes.append(lost)

        threads = [threading.Thread(target=run, args=(n,)) for n in range(3)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert len([x for x in outcomes if isinstance(x, int)]) == 1 and len(outcomes) == 3
    ids = [r.vote_id for r in snapshots.load(spark, root)[0].votes.where("vote_id >= 1000").collect()]
    assert sorted(i // 10 for i in ids) == [100, 101]


def test_runs_on_different_tables_are_put_on_top_of_each_other(seed, spark, tmp_path):
    root = str(tmp_path / "store")
    snapshots.save(seed, root)
    one, _ = snapshots.load(spark, root)
    two, _ = snapshots.load(spark, root)
    three, _ = snapshots.load(spark, root)
    assert snapshots.save(votes_where(one, "vote_id < 3"), root, ["votes"]) == 2
    promoted = two.with_tables(users=two.users.where("user_id <> 5"))
    assert snapshots.save(promoted, root, ["users"]) == 3
    with pytest.raises(snapshots.ConcurrentChange):  # it has read what version 2 changed
        snapshots.save(three.with_tables(rules=three.rules.limit(0)), root, ["rules"], reads=["votes"])
    now, _ = snapshots.load(spark, root)
    assert (now.votes.count(), now.users.count(), now.rules.count()) == (2, 4, 8)
    assert snapshots.load(spark, root, 1)[0].votes.count() == 6


def test_a_run_that_dies_blocks_nobody(seed, spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    snapshots.save(seed, root)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_announce", dies)
        with pytest.raises(KeyboardInterrupt):
            snapshots.save(votes_where(seed, "vote_id < 3"), root, ["votes"])
    (tmp_path / "store" / "manifest" / "_half.tmp").write_text('{"version"')
    assert snapshots.load(spark, root)[0].votes.count() == 6
    assert snapshots.save(votes_where(seed, "vote_id < 5"), root, ["votes"]) == 2
    assert snapshots.load(spark, root)[0].votes.count() == 4


def written_rows(spark, root, name, kind):
    entry = snapshots._latest(spark, root)
    folder = entry.changes[name][-1][kind]
    return spark.read.parquet(folder).count()


def test_change_sets_equal_whole_tables(seed, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_CHANGES", 3)
    root, whole = str(tmp_path / "store"), str(tmp_path / "whole")
    snapshots.save(seed, root)
    snapshots.save(seed, whole)
    steps = [
        (lambda t: intake.delete_submissions(t, url_ids=t.url_submissions.where("url_id in (1, 9)").select("url_id")).tables),
        (lambda t: maintenance.reclassify_by_votes(t, DAY).tables),
        (lambda t: t.with_tables(votes=t.votes.unionByName(table(spark, "votes", [(50, 3, 7, 1, DAY)])))),
        (lambda t: maintenance.cleanup_rule_matches(t).tables),
        (lambda t: t.with_tables(votes=t.votes.where("vote_id <> 50").unionByName(table(spark, "votes", [(2, 4, 3, -1, DAY)])))),
    ]
    names = snapshots.Tables.names()
    for n, step in enumerate(steps):
        t, _ = snapshots.load(spark, root)
        snapshots.save_changes(t, step(t), root, names)
        w, _ = snapshots.load(spark, whole)
        snapshots.save(step(w), whole)
        if n == 0:
            assert (written_rows(spark, root, "url_submissions", 0), written_rows(spark, root, "url_submissions", 1)) == (0, 2)
        got, marks = snapshots.load(spark, root)
        want, other_marks = snapshots.load(spark, whole)
        assert marks == other_marks
        for name in names:
            assert sorted(map(repr, getattr(got, name).collect())) == sorted(map(repr, getattr(want, name).collect())), (n, name)
    # After three change sets the fourth run wrote the table whole.
    assert len(snapshots._latest(spark, root).changes.get("votes", [])) == 1
