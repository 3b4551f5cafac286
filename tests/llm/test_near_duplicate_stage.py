"""The near duplicate stage against brute force at its own figures: five words, Jaccard 0.8 or more."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from snarelight.llm import common, jaccard


def components_of(rows, size, part):
    """rows: (doc_id, text). The smallest id of each row's component."""
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, o in enumerate(sets[:i]):
            if s and o and 100 * len(s & o) >= part * len(s | o):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(rows))]


def made_rows():
    rng = random.Random(21)
    pick = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        base = pick(rng.randint(60, 250))
        texts.append(base)
        for changes in (1, 2, 3, 4, 6):
            text = list(base)
            for _ in range(changes):
                text[rng.randrange(len(text))] = rng.choice(["x", "y", "z"])
            texts.append(text)
        texts.append(base[: int(len(base) * 0.85)])
    # Around the threshold itself: 80 shingles of 100, and 79.
    base = [f"v{i}" for i in range(104)]
    texts += [base, base[:84], [f"u{i}" for i in range(104)], [f"u{i}" for i in range(83)], ["one", "two"], ["one", "two"], []]
    return [(900 - i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("place", [4096, 8])
def test_stage_equals_brute_force(spark, monkeypatch, place):
    monkeypatch.setattr(jaccard, "PLACE", place)
    rows = made_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = set(components_of(rows, 5, 80))
    assert want != set(components_of(rows, 3, 90))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(want)


def test_join_figures_are_parameters(spark):
    rows = made_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    ids = [d for d, _ in rows]
    for size, part in ((5, 80), (3, 90), (2, 60)):
        got = {r["doc_id"]: r["component_id"] for r in jaccard.join_components(docs, size=size, part=part).collect()}
        assert got == dict(zip(ids, components_of(rows, size, part), strict=True))


@pytest.mark.parametrize("part", [80, 90])
def test_parities_of_long_sets_lose_no_pair_and_let_few_through(part):
    rng = np.random.default_rng(part)
    fresh = lambda n: rng.integers(0, 1 << 62, n).astype(np.uint64)
    sets = []
    for n in (500, 520, 1030, 4090, 4100, 9000, 16380, 40000):
        base = np.unique(fresh(n))
        # Near sets on both sides of a width, sets that share half, and unrelated ones.
        sets += [base, base[: int(n * 0.93)], np.unique(np.concatenate([base, fresh(n // 12)]))]
        sets += [np.unique(np.concatenate([base[: n // 2], fresh(n // 2)])), np.unique(fresh(n))]
    sizes = np.array([len(s) for s in sets])
    parities = jaccard.Parities([jaccard.point_of(s) for s in sets], sizes, part)
    assert len(set(parities.widths.tolist())) > 4 and sizes.max() > jaccard.MOST_BITS
    passed = linked = 0
    for i, s in enumerate(sets):
        others = np.arange(i)
        close = parities.close(i, others)
        assert (close == [parities.close(j, np.array([i]))[0] for j in others.tolist()]).all()
        for j in others.tolist():
            shared = len(np.intersect1d(s, sets[j]))
            link = 100 * shared >= part * (len(s) + len(sets[j]) - shared)
            assert close[j] or not link
            if max(sizes[i], sizes[j]) < jaccard.MOST_BITS and min(sizes[i], sizes[j]) * 100 >= part * max(sizes[i], sizes[j]):
                passed, linked = passed + close[j], linked + link
    assert linked <= passed <= 2 * linked


def sparse_group(members=12):
    """Copies of one text with changes of their own, far apart: most pairs are just below the threshold, a few above."""
    base = [f"b{i}" for i in range(400)]
    out = []
    for k in range(members):
        text = list(base)
        for at in [5 * (k + members * t) + 4 for t in range(4 + (k % 3 > 0))]:
            text[at] = f"c{k}x{at}"
        out.append((k, " ".join(text)))
    return out


def test_second_round_emits_no_more_pairs_than_entries(spark, monkeypatch):
    rows = sparse_group()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = dict(zip([d for d, _ in rows], components_of(rows, 5, 80), strict=True))
    assert 1 < len(set(want.values()))
    written, keep = {}, jaccard.stored

    def counted(df, label):
        out = keep(df, label)
        written.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stored", counted)
    for block in (jaccard.BLOCK_SHINGLES, 4000):
        monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
        got = {r["doc_id"]: r["component_id"] for r in jaccard.join_components(docs, size=5, part=80).collect()}
        assert got == want
    first, second = written["pairs"][:2]
    assert max(written["members"]) > 0 and second < len(rows)


def test_python_tasks_of_the_join_get_few_bytes_at_a_time(spark, monkeypatch):
    name, keep, during = "spark.sql.execution.arrow.maxBytesPerBatch", jaccard.stored, []

    def watched(df, label):
        during.append(int(spark.conf.get(name)))
        return keep(df, label)

    before = spark.conf.get(name)
    monkeypatch.setattr(jaccard, "stored", watched)
    rows = made_rows()
    assert jaccard.join_components(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == len(rows)
    assert spark.conf.get(name) == before
    assert during and set(during) == {common.BATCH_BYTES}

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    texts = spark.range(0, 400, 1, 1).selectExpr("repeat('word ', 20000) as text")
    with common.small_batches(spark):
        got = texts.mapInArrow(sizes, "n bigint, bytes bigint").collect()
    assert sum(r["n"] for r in got) == 400
    assert max(r["bytes"] for r in got) < 2 * common.BATCH_BYTES
