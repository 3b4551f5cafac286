import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_near_duplicate_stage import components_of

import corpus_pipeline
from snarelight.llm import common, components, jaccard, lm, quality, repeats

SPLIT = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in lowered.translate(SPLIT).split(" ") if w]


def kept_rows(rows, length=400):
    seen = Counter()
    for body in rows:
        for p in range(len(body) - length + 1):
            seen[body[p : p + length]] += 1
    for body in rows:
        mask = bytearray(len(body))
        for p in range(len(body) - length + 1):
            if seen[body[p : p + length]] > 1:
                mask[p : p + length] = b"\1" * length
        kept = bytes(c for c, x in zip(body, mask, strict=True) if not x)
        runs = len([x for x in bytes(mask).split(b"\0") if x])
        yield len(body), sum(mask), runs, kept


def made_texts():
    rng = random.Random(4)
    letters = "abcdefgh éñ\n"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = make(1500)
    out = [make(rng.randint(0, 1200)) for _ in range(12)]
    out += [make(100) + shared + make(50), shared[200:1300] + make(30), make(20) + shared[:399], make(5) + shared[:400] + make(5)]
    changed = list(shared * 2)
    for at in range(0, len(changed), 450):
        changed[at] = "#"
    out += ["".join(changed), shared + shared, "z" * 900, "ab" * 700, "z" * 399, "y" * 400, out[0], out[0], "", None]
    return out


@pytest.mark.parametrize("segment", [512 << 10, 700])
def test_repeats_equal_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(repeats, "SEGMENT_BYTES", segment)
    texts = made_texts()
    rows = [(i if i % 7 else None, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_bytes string").withColumn("t", F.col("text"))
    got = repeats.remove_repeats(docs, with_bytes=True).collect()
    want = dict(zip(texts, kept_rows([(t or "").encode() for t in texts]), strict=True))
    assert len(got) == len(texts)
    for r in got:
        n, removed, runs, kept = want[r["t"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (n, removed, runs)
        assert bytes(r["kept"]) == kept and r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_repeats_of_documents(sample, empty, odd):
    got = repeats.remove_repeats(sample.withColumn("t", F.col("text"))).collect()
    want = list(kept_rows([r["t"].encode() for r in got]))
    for r, (n, removed, runs, kept) in zip(got, want, strict=True):
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (n, removed, runs)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert repeats.remove_repeats(empty).count() == 0
    assert repeats.remove_repeats(odd).count() == odd.count()


def expected_components(rows):
    """rows: (doc_id, text). The set sizes, and the smallest id of each row's component."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in where[x])
        for j, n in shared.items():
            if 100 * n >= 90 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for x in s:
            where[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [len(s) for s in sets], [least.get(find(i)) if s else rows[i][0] for i, s in enumerate(sets)]


def near_texts():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(200)]
    out = [base]
    for k in range(1, 40):
        text = list(base)
        for _ in range(k % 7):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        out.append(text)
    out += [[rng.choice(vocabulary) for _ in range(rng.randint(1, 80))] for _ in range(40)]
    big = [rng.choice(vocabulary) for _ in range(1100)]
    out += [big, big[:-60], big[:1010], ["only"], ["only"], ["two", "words"], ["two", "words"]]
    return [" ".join(t) for t in out] + ["Only", None, "", " \n"]


@pytest.mark.parametrize("place", [4096, 8])
def test_join_components_equal_brute_force(spark, monkeypatch, place):
    monkeypatch.setattr(jaccard, "PLACE", place)
    rows = [(500 - i, t) for i, t in enumerate(near_texts())]
    rows += [rows[3], rows[3], (None, rows[5][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, component_id int")
    got = jaccard.join_components(docs.withColumn("t", F.col("text"))).collect()
    sizes, least = expected_components(rows)
    assert sorted(map(str, ((r["doc_id"], r["t"], r["n_shingles"], r["component_id"]) for r in got))) == sorted(
        map(str, ((*r, n, c) for r, n, c in zip(rows, sizes, least, strict=True)))
    )
    kept = jaccard.keep_one(docs).collect()
    assert len(kept) == len({c for c, n in zip(least, sizes, strict=True) if n}) + sizes.count(0)


def test_join_of_odd_rows(odd, empty):
    assert jaccard.join_components(odd).count() == odd.count()
    assert jaccard.join_components(empty).count() == 0 and jaccard.keep_one(empty).count() == 0
    assert jaccard.keep_one(odd).columns == odd.columns


def test_tree_search_loses_no_pair():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 62, rng.integers(1, 1500)).astype(np.uint64)) for _ in range(60)]
    for s in list(sets):
        sets.append(np.unique(np.concatenate([s[: int(len(s) * 0.97)], rng.integers(0, 1 << 62, len(s) // 60).astype(np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    raw = [jaccard.point_of(s) for s in sets]
    table, parities = jaccard.points(raw, sizes), jaccard.Parities(raw, sizes)
    tree = jaccard.RTree(table, sizes)
    few = 0
    for i, s in enumerate(sets):
        near = tree.search(table[i], sizes[i])
        found = set(near[parities.close(i, near)].tolist())
        few += len(found)
        for j, o in enumerate(sets):
            shared = len(np.intersect1d(s, o))
            if 100 * shared >= 90 * (len(s) + len(o) - shared):
                assert j in found
    assert few < 10 * len(sets)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (7, 3), (300, 299)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {299: 299, 300: 299}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("bits", [20, 6])
def test_language_model_base_scores(spark, sample, odd, monkeypatch, bits):
    monkeypatch.setattr(lm, "HEAD_BITS", bits)  # with few bits most words meet their counts in the join
    for df in (sample, odd.select("doc_id", "text")):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        counts = Counter()
        for d, t in rows:
            if zlib.crc32(("" if d is None else str(d)).encode()) % 10:
                counts.update([*words(t), None])
        total = sum(counts.values())
        want = []
        for d, t in rows:
            symbols = [*words(t), None]
            base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in symbols)
            held = zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
            want.append((d, held, len(symbols), sum(counts[w] > 0 for w in symbols), total, round(base, 4)))
        got = [
            (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4))
            for r in lm.score(df).collect()
        ]
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_tree_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = lm.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1]


def chain_model(rows, depth, least_next, least_context):
    """The suffix tree by plain dictionaries; returns a text's score and the distribution after a history."""
    train = [t for d, t in rows if zlib.crc32(str(d).encode()) % 10]
    unigrams = Counter(w for t in train for w in [*words(t), None])
    total = sum(unigrams.values())
    norm = total + 0.1 * (len(unigrams) + 1)
    after = defaultdict(Counter)
    for t in train:
        symbols = [None, *words(t), None]
        for i in range(1, len(symbols)):
            for k in range(1, min(depth, i) + 1):
                after[tuple(symbols[i - k : i])][symbols[i]] += 1
    kept = {}

    def p(history, x):
        for k in range(min(depth, len(history)), 0, -1):
            if (state := kept.get(history[-k:])) is not None:
                listed, other = state
                return listed[x] if x in listed else other * p(history[len(history) - k + 1 :], x)
        return (unigrams[x] + 0.1) / norm

    for k in range(1, depth + 1):
        for c in [c for c in after if len(c) == k]:
            n = sum(after[c].values())
            listed = {x: (m - 0.5) / n for x, m in after[c].items() if m >= least_next}
            if n < least_context or not listed:
                continue
            parent = {x: p(c[1:], x) for x in listed}
            rest, parent_rest = 1 - sum(listed.values()), 1 - sum(parent.values())
            rest, parent_rest = max(rest, 1e-12), max(parent_rest, 1e-12)
            bits = sum(q * math.log2(q / parent[x]) for x, q in listed.items()) + rest * math.log2(rest / parent_rest)
            if bits >= 0.02 and bits * n >= 10:
                kept[c] = (listed, rest / parent_rest)

    def text_score(t):
        symbols = (None, *words(t), None)
        return sum(math.log10(p(symbols[:i], symbols[i])) for i in range(1, len(symbols)))

    return text_score, p, kept, unigrams, norm


def rhymes():
    """Texts with dependencies of one to three words, copies, a null and a long text."""
    rng = random.Random(8)
    rows = []
    for d in range(300):
        out = []
        for _ in range(rng.randint(0, 40)):
            out += rng.choice(["a b c d", "x b c e", "a b f", "g", "h i", "b c"]).split() + [f"w{rng.randint(0, 300)}"] * rng.randint(0, 1)
        rows.append((d, " ".join(out)))
    return [*rows, (300, None), (301, "a b c " * 3000), *[(400 + i, rows[7][1]) for i in range(20)]]


@pytest.mark.parametrize(("hot", "least_next", "least_context"), [(20, 4, 64), (5, 2, 8)])
def test_language_model_scores(spark, monkeypatch, hot, least_next, least_context):
    monkeypatch.setattr(lm, "HOT_BITS", hot)  # with few bits most strings meet their factors in the join
    rows = rhymes()
    text_score, p, kept, unigrams, norm = chain_model(rows, 3, least_next, least_context)
    assert {len(c) for c in kept} == {1, 2, 3}
    got = lm.score(spark.createDataFrame(rows, "doc_id bigint, text string"), least_next=least_next, least_context=least_context)
    got = {r["doc_id"]: r["score"] for r in got.collect()}
    assert got == {d: pytest.approx(text_score(t), abs=1e-6) for d, t in rows}
    for c in kept:
        unknown = 0.1 / norm
        for k in range(1, len(c) + 1):
            unknown *= kept[c[-k:]][1] if c[-k:] in kept else 1
        assert sum(p(c, x) for x in unigrams) + unknown == pytest.approx(1, abs=1e-6)


def test_language_model_scores_with_many_buckets(spark, monkeypatch):
    labels, plans, stored = [], [], lm.stored

    def recorded(df, label, **options):
        labels.append(label)
        plans.append(df._jdf.queryExecution().toString())
        return stored(df, label, **options)

    monkeypatch.setattr(lm, "stored", recorded)
    monkeypatch.setattr(lm, "COUNTED_KEYS", 256)  # contexts seen 64 times are spread over the buckets by what follows them
    monkeypatch.setattr(lm, "RARE_KEYS", 256)
    monkeypatch.setattr(lm, "HEAD_BITS", 8)
    monkeypatch.setattr(lm, "HOT_BITS", 5)
    rows = rhymes()
    text_score, *_ = chain_model(rows, 3, 2, 8)
    got = lm.score(spark.createDataFrame(rows, "doc_id bigint, text string"), least_next=2, least_context=8)
    assert {r["doc_id"]: r["score"] for r in got.collect()} == {d: pytest.approx(text_score(t), abs=1e-6) for d, t in rows}
    # Strings and words are shuffled as packed rows, one for a bucket; no second table has their halves.
    assert "halves" not in labels
    for label in ("unigrams", "counted1", "counted2", "counted3"):
        assert "FlatMapGroupsInArrow" in plans[labels.index(label)], label
    assert labels.count("found") == lm.ROUNDS


def test_packed_numbers_and_words_come_back():
    rng = np.random.default_rng(5)
    digests = np.sort(rng.integers(-(2**63), 2**63 - 1, 1000).view(np.uint64)).view(np.int64)
    assert (lm._unstepped(lm._steps(digests), 1000) == digests).all()
    ranked, found = digests[::3], rng.choice(digests, 5000)
    rank = pd.Index(ranked).get_indexer(found) + 1
    assert (lm._word_array(lm._word_blob(found, rank), 5000, ranked) == found).all()
    bucket = lm._bucket(digests, 7).astype(int)
    assert (np.diff(bucket) >= 0).all() and set(bucket) == set(range(7))


def test_sliced_texts_keep_their_words():
    texts = pa.array([f"a{i} b c{i % 7}" if i % 5 else None for i in range(1000)])
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    got = [w for piece in common.arrow_slices([batch], 0, 100) for w in common.split_words(piece.column(0))[0].to_pylist()]
    assert got == [w for t in texts.to_pylist() for w in words(t)]


def test_tree_grows_with_the_corpus(spark):
    sizes = []
    for sf in ("0.001", "0.01"):
        docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
        counts = lm.unigrams(docs, "text", "doc_id")
        _, contexts = lm.tree(docs, counts, lm.head_of(counts).log_norm, "text", "doc_id")
        sizes.append([c.count() for c in contexts])
    # Contexts of three words are few in so small tables.
    assert all(b > 1.5 * a for a, b in zip(sizes[0][:2], sizes[1][:2], strict=True)) and sizes[1][2] >= sizes[0][2], sizes


def test_language_model_keeps_clashing_columns(spark):
    names = ["_row", "_score", "_rare", "_tail", "_text", "_user", "a.b", "word", "id", "c"]
    row = (1, "a b", *range(len(names)))
    df = spark.createDataFrame([row], "doc_id bigint, text string, " + ", ".join(f"`{n}` bigint" for n in names))
    out = lm.score(df).first().asDict()
    assert [out[n] for n in names] == list(range(len(names)))


def test_language_model_of_empty_tables(empty):
    assert lm.score(empty).count() == 0


def test_pipeline_stages_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    good = corpus_pipeline.quality_rules(spark, docs, sf)
    assert good.columns == docs.columns
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    single = corpus_pipeline.near_duplicates(spark, good, sf)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(components_of(rows, 5, 80)))
    clean = corpus_pipeline.decontamination(spark, single, sf)
    assert clean.columns == docs.columns and clean.count() <= single.count()
    result = corpus_pipeline.run(spark, sf).collect()
    mixed = corpus_pipeline.mixture(spark, clean, sf)
    assert Counter(r["doc_id"] for r in result) == Counter(r["doc_id"] for r in mixed.collect())
    assert {r["shard"] for r in result} <= set(range(24))


def test_bitmaps_of_strings_lose_none_and_let_few_others_through(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 16)
    digests = spark.range(40_000).selectExpr("id", "xxhash64(id) as key")
    keys = digests.where("id < 6000")
    rows = digests.orderBy("id").toArrow().column("key").to_numpy()
    assert lm.may_hold(lm.key_filter(keys, "key"), rows[:6000]).all()
    assert lm.may_hold(lm.key_filter(keys, "key"), rows[6000:]).mean() < 0.05
    one = common.key_filter(keys, "key")
    assert common.may_hold(one, rows[:6000]).all() and common.may_hold(one, rows[6000:]).mean() > 0.07
