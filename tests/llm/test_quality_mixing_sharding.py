import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from snarelight.llm import mixing, quality, sharding

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    out, at = [], ""
    for c in text or "":
        if c in SPACE:
            if at:
                out.append(at)
            at = ""
        else:
            at += c
    return [*out, at] if at else out


def expected_metrics(text):
    text, w = text or "", words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


@pytest.mark.parametrize("which", ["odd", "sample"])
def test_quality_metrics_equal_brute_force(request, which):
    df = request.getfixturevalue(which)
    for row in quality.judge(df.select("doc_id", "text", F.col("text").alias("t"))).collect():
        want = expected_metrics(row["t"])
        assert tuple(row[m] for m in quality.METRICS) == want
        assert row["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (row["base_failed"] and row["kept"])


def test_quality_keeps_columns_and_handles_empty_tables(odd, empty):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_quality_is_one_projection_without_python_or_shuffle(odd):
    plan = quality.judge(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def expected_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Sharing again by rounds."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > most * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


@pytest.mark.parametrize("which", ["odd", "sample"])
def test_mixing_targets_and_taken_words(request, which):
    df = request.getfixturevalue(which)
    rows = mixing.mix_report(df).join(df.select(F.col("doc_id").alias("d"), F.col("text").alias("t")).distinct(), F.col("doc_id").eqNullSafe(F.col("d"))).collect()
    assert len(rows) == df.count()
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r["size"] == len(words(r["t"]))
        assert r["taken"] == r["size"] * r["copies"] <= 2 * r["size"]
        assert len(r["positions"]) == r["copies"] and all(0 <= p <= 1 for p in r["positions"])
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
    want = expected_targets(sizes)
    for s in sizes:
        assert targets[s] == pytest.approx(want[s])
        if which == "sample":  # ten documents a source, taken whole
            assert abs(taken[s] - targets[s]) <= 0.25 * targets[s]


def test_taken_words_come_near_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    report = mixing.mix_report(docs).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"))
    assert all(abs(r["k"] - r["t"]) <= 0.005 * r["t"] for r in report.collect())


@pytest.mark.parametrize("shift", [0, 1, 2, 3])
def test_short_texts_fill_what_a_long_one_leaves(spark, shift):
    rows = [(shift * 100_000, "long", 1_000_000)] + [(shift * 100_000 + 1 + i, "long", 100) for i in range(10_000)]
    rows += [(900_000 + i, "other", 250_000) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n int").select("doc_id", "source", F.repeat(F.lit("w "), F.col("n")).alias("text"))
    for r in mixing.mix_report(docs).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect():
        if r["source"] == "long":
            assert abs(r["k"] - r["t"]) <= 100


def test_taken_documents_equal_a_walk_through_them(sample):
    report = mixing.mix_report(sample).collect()
    own = {r["doc_id"]: hashlib.md5(f"{r['doc_id']}:{hashlib.md5(r['text'].encode()).hexdigest()}".encode()).hexdigest() for r in sample.collect()}
    by_source = defaultdict(list)
    for r in report:
        by_source[r["source"]].append(r)
    for rows in by_source.values():
        rows.sort(key=lambda r: own[r["doc_id"]])
        passes = int(rows[0]["target"] // rows[0]["source_size"])
        room, extra = rows[0]["target"] - passes * rows[0]["source_size"], set()
        for r in rows:
            if 0 < r["size"] <= room:
                room -= r["size"]
                extra.add(r["doc_id"])
        over = [(r["size"], own[r["doc_id"]], r["doc_id"]) for r in rows if r["doc_id"] not in extra and room < r["size"] < 2 * room]
        extra |= {min(over)[2]} if over else set()
        assert {r["doc_id"]: r["copies"] for r in rows} == {r["doc_id"]: passes + (r["doc_id"] in extra) for r in rows}


def test_mixing_reruns_agree_and_copies_rows(odd, sample, empty):
    a = sorted(map(str, mixing.mix_report(sample).collect()))
    assert a == sorted(map(str, mixing.mix_report(sample.repartition(5)).collect()))
    report = mixing.mix_report(odd)
    assert mixing.mix(odd).count() == report.agg(F.sum("copies")).first()[0]
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0 and mixing.mix_report(empty).count() == 0


def test_position_inverts_the_integral(spark):
    schedule = mixing.Schedule(((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)))
    shares = [i / 20 for i in range(21)]
    df = spark.createDataFrame([(s,) for s in shares], "s double")
    got = [r[0] for r in df.select(mixing.position_at(F.col("s"), schedule)).collect()]

    def integral(t):
        total, knots = 0.0, schedule.knots
        for (t0, r0), (t1, r1) in zip(knots, knots[1:], strict=False):
            x = min(max(t - t0, 0), t1 - t0)
            total += r0 * x + (r1 - r0) / (t1 - t0) * x * x / 2
        return total

    assert got == sorted(got)
    for s, t in zip(shares, got, strict=True):
        assert integral(t) == pytest.approx(s * integral(1.0), abs=1e-9)


def test_mixing_is_native(sample):
    plan = mixing.mix_report(sample)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_differencing_deals_every_item_and_balances():
    rng = random.Random(3)
    # 8-7, 6-5, then 4-1, 3-1: differencing ends at a spread of 2.
    sums = Counter()
    for size, way in zip([8, 7, 6, 5, 4], sharding.differenced([8, 7, 6, 5, 4], 2), strict=True):
        sums[way] += size
    assert sorted(sums.values()) == [14, 16]
    for n, k in ((1, 3), (5, 8), (200, 24), (3000, 7)):
        sizes = [rng.randint(1, 1000) for _ in range(n)]
        ways = sharding.differenced(sizes, k)
        sums = [0] * k
        for s, w in zip(sizes, ways, strict=True):
            sums[w] += s
        assert len(ways) == n and set(ways) <= set(range(k))
        if n >= 200:
            assert max(sums) - min(sums) <= 30  # of at least 4,000
    assert sharding.differenced([], 4) == []


@pytest.mark.parametrize("bucket", [20_000, 40])
def test_sharding_contract(odd, sample, empty, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "BUCKET_ITEMS", bucket)
    if bucket < 100:
        monkeypatch.setattr(sharding, "TOP_ITEMS", 120)  # several levels
    for df in (odd, sample):
        rows = sharding.assign_shards(df, 24 if bucket > 100 else 6).collect()
        assert len(rows) == df.count()
        by_text, by_shard, load = defaultdict(set), defaultdict(list), Counter()
        for r in rows:
            body = (r["text"] or "").encode()
            assert r["size"] == len(body) + 8 and r["text_crc32"] == zlib.crc32(body)
            by_text[r["text"]].add(r["shard"])
            by_shard[r["shard"]].append(r["slot"])
            load[r["shard"]] += r["size"]
        assert all(len(s) == 1 for s in by_text.values())
        assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
        if df is sample and bucket < 100:
            assert max(load.values()) < 1.1 * min(load.values())
    assert sharding.assign_shards(empty).count() == 0
