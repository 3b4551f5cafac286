"""Spelling variants, embeddings and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from snarelight.llm import embeddings, periodic, spelling
from snarelight.llm.oracles import ORACLES
from snarelight.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plain_rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def expected_variants(rows, every, least=3):
    counts = Counter()
    for own, text in rows:
        lowered = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for w in re.findall("[a-zA-Z\u00c0-\u00ff]+", lowered):
            h = zlib.crc32(f"{'' if own is None else own}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}
    near, holes = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
    for w in counts:
        for i in range(len(w)):
            near[w] |= holes[w[:i], w[i + 1 :]] - {w}
            shorter = w[:i] + w[i + 1 :]
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(map(repr, out))


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aabb\u00ff\u00e9") for _ in range(rng.randint(3, 8)))
    rows = [(rng.randrange(40), " ".join(word() for _ in range(200))) for _ in range(30)]
    rows += [(None, None), (7, ""), (8, "Aaaaa" * 3000 + " aaaaab \u00d7\u00f7aaab \u0100baaab"), (None, "house House HOUSE houses")] * 3
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    got = spelling.variants(docs, doc_id="doc_id", change=spelling.drop_letter(7))
    assert plain_rows(got) == expected_variants(rows, 7)
    assert plain_rows(spelling.variants(docs)) == expected_variants(rows, None)


def test_trie_nodes_are_numbered_alike_in_all_partitions(spark):
    words = sorted({"".join(p) for n in range(1, 6) for p in product("abc", repeat=n)})
    given = spark.createDataFrame(list(enumerate(words)), "word_id bigint, word string").repartition(7)
    nodes = {words[r["word_id"]]: r["before"] for r in spelling.trie_nodes(given, "word", "before").collect()}
    number = {}
    for w, path in nodes.items():
        assert len(path) == len(w) + 1
        for n, x in enumerate(path):
            assert number.setdefault(w[:n], x) == x
    assert sorted(number.values()) == list(range(len(number)))


def test_variants_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert plain_rows(QUERIES["op11_spelling_variants"](spark, SF_DIR)) == expected_variants(docs, 97)


def expected_vectors(rows, threshold):
    unit = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / max(map(abs, v))
            unit[k] = x / np.linalg.norm(x)
    links, up = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in unit:
        for b in unit:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                up[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[find(k)].append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(repr((i, links[k], least[find(k)], i == least[find(k)])) for k, (i, _) in enumerate(rows))


def made_vectors():
    rng = np.random.default_rng(2)
    rows = []
    for n, d in ((300, 24), (60, 3), (40, 1)):
        middle = rng.normal(size=(8, d))
        for k in range(n):
            x = middle[rng.integers(8)] + rng.normal(size=d) * rng.choice([0, 0.1, 0.3, 0.45]) if k % 3 else rng.normal(size=d)
            rows.append((len(rows) if k % 50 else None, (x * rng.choice([1, 3, 1e-200, 1e200])).tolist()))
    rows += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [1.0] * 23 + [None]), (1004, [float("nan")] * 24)]
    return rows + [(1005, [float("inf")] + [1.0] * 23), rows[5], rows[5], (2000, [-0.0, 1.0, 0.0]), (1999, [0.0, 2.0, -0.0])]


@pytest.mark.parametrize(("tile", "block", "threshold"), [(1024, 32 << 20, 0.9), (16, 24 * 8 * 40, 0.9), (8, 24 * 8 * 40, 0.3)])
def test_vectors_equal_brute_force(spark, monkeypatch, tile, block, threshold):
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "BLOCK_BYTES", block)
    rows = made_vectors()
    given = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(6)
    assert plain_rows(embeddings.near_vectors(given, keep=["vec_id"], threshold=threshold)) == expected_vectors(rows, threshold)


def test_vectors_odd_columns_and_empty(spark):
    rows = [(1, [1.0, 0.0], "x", 5, "a"), (2, [1.0, 0.01], "y", 6, "b"), (3, None, "z", None, None)]
    given = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, KEPT string, `a.b` int, _v string")
    got = embeddings.near_vectors(given)
    assert got.columns == ["vec_id", "a.b", "_v", "n_links", "component_id", "kept"]
    assert plain_rows(got) == sorted(map(repr, [(1, 5, "a", 1, 1, True), (2, 6, "b", 1, 1, False), (3, None, None, 0, 3, True)]))
    assert embeddings.near_vectors(given.where("false")).collect() == []


def test_bounds_drop_no_pair():
    rng = np.random.default_rng(5)
    raw = np.concatenate([rng.normal(size=(200, 32)), rng.normal(size=(1, 32)) + 0.2 * rng.normal(size=(100, 32))])
    unit = embeddings.units(raw)
    share, basis = np.linalg.eigh(unit.T @ unit)
    for first in (1, 4, 8, 32):
        block = embeddings.Block(raw, embeddings.Axes(32, basis[:, ::-1], first))
        whole = slice(0, 300)
        i, j = embeddings.tile_pairs(block, whole, block, whole, 0.8)
        want = np.argwhere(unit @ unit.T >= 0.8)
        assert sorted(zip(block.order[i].tolist(), block.order[j].tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


def test_vectors_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{SF_DIR}/embeddings.parquet'")
    want = duck.execute(ORACLES["op12_embedding_near_dedup"])
    names = [d[0] for d in want.description]
    got = QUERIES["op12_embedding_near_dedup"](spark, SF_DIR)
    assert plain_rows(got.select(names)) == sorted(map(repr, want.fetchall()))
    # SQL squares without scaling first.
    mild = lambda x: x is None or not np.isfinite(x) or x == 0 or 1e-100 < abs(x) < 1e100
    rows = [(i, v) for i, v in made_vectors() if i is not None and all(map(mild, v or []))]
    rows = rows[:200] + rows[-30:]
    duck.execute("create or replace table embeddings_made (vec_id bigint, embedding double[])")
    duck.executemany("insert into embeddings_made values (?, ?)", rows)
    want = duck.execute(ORACLES["op12_embedding_near_dedup"].replace("FROM embeddings", "FROM embeddings_made"))
    assert sorted(map(repr, want.fetchall())) == expected_vectors(rows, 0.9)


def expected_runs(w, least=24, times=3):
    out = set()
    for q in range(1, len(w) // times + 1):
        begin = None
        for i in range(q, len(w) + 1):
            if i < len(w) and w[i] == w[i - q]:
                begin = i if begin is None else begin
            elif begin is not None:
                s, n = begin - q, i - begin + q
                part = w[s : s + n]
                if n >= max(least, times * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.add((s, n, q))
                begin = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def expected_digest(own, text):
    w = split(text)
    h = zlib.crc32(str(own).encode()) if own is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = expected_runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (own, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest(lines), digest(kept))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.randint(0, 90), rng.choice([1, 2, 3, 5, 20])
            w = [rng.randrange(k) for _ in range(n)]
            if w and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)] + [rng.randrange(k) for _ in range(rng.choice([0, 20]))]
            texts.append(w)
        numbers = np.array([x for w in texts for x in w], np.int64)
        ends = np.cumsum([len(w) for w in texts])
        starts = ends - [len(w) for w in texts]
        for least, times in ((24, 3), (6, 2), (9, 4)):
            assert periodic.runs_of(numbers, starts, ends, least, times) == [expected_runs(w, least, times) for w in texts]


def test_access_gives_last_occurrences():
    rng = random.Random(8)
    for _ in range(100):
        w = [rng.randrange(2) for _ in range(rng.randint(1, 40))]
        link, length, ends = periodic.automaton(w)
        paths = periodic.Paths(link)
        for end, state in enumerate(ends, 1):
            got = {}
            for before, lowest in paths.access(state, end):
                got[before] = length[lowest]
            want = {}
            for n in range(1, end):
                last = max((e for e in range(n, end) if w[e - n : e] == w[end - n : end]), default=None)
                if last:
                    want[last] = n
            assert got == want


def test_runs_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op13_periodic_runs"](spark, SF_DIR)
    assert plain_rows(got) == sorted(repr(expected_digest(i, t)) for i, t in docs)
    assert got.where("n_runs > 0").count() > 5


def test_runs_of_odd_and_empty_tables(spark, odd, empty):
    docs = odd.withColumn("a.b", F.lit("x")).withColumn("RUNS", F.lit("y"))
    got = periodic.find_runs(docs)
    assert got.columns == ["doc_id", "source", "Size", "label", "a.b", "n_words", "runs", "collapsed"]
    want = []
    for r in docs.collect():
        w = split(r["text"])
        runs = expected_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append(repr((r["doc_id"], len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone))))
    rows = got.select("doc_id", "n_words", "runs", "collapsed").collect()
    assert sorted(repr((r[0], r[1], [tuple(x) for x in r[2]], r[3])) for r in rows) == sorted(want)
    assert periodic.find_runs(empty).collect() == []
    assert spelling.variants(empty, doc_id="doc_id").collect() == []
    assert {r["word"] for r in spelling.variants(odd, doc_id="doc_id").collect()} >= {"quick", "house", "garden"}
