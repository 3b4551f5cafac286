"""The pipeline's stages on odd and empty tables and on columns named like the operators' own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

NAMES = [
    "a.b", "_id", "_part", "_key", "_hash", "_src", "_size", "_hit", "_words", "_row", "_user", "_at", "_text", "_set", "_label", "n_hit", "kept",
    "size", "shard", "copies", "component_id", "matches", "positions", "doc id",
]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:4], ids=lambda s: s[0])
def test_stages_keep_all_columns(spark, odd, empty, stage):
    good = "It is the first line of a story that was told in the house by the sea and of the people in it.\n" * 2
    more = [(20 + i, "".join(f"{w} w{i}x{k} " for k, w in enumerate(good.split())), "a", 1, "x", "l") for i in range(2)]
    docs = odd.unionByName(spark.createDataFrame(more, odd.schema)).drop("Size")
    for name in NAMES:
        docs = docs.withColumn(name, F.concat_ws("-", F.lit(name), F.col("doc_id"), F.length("text")))
    rows = stage[1](spark, docs, "/root/testdata/sf0.001").collect()
    assert rows
    for r in rows:
        assert r.__fields__ == docs.columns
        for name in NAMES:
            assert r[name] == "-".join(str(x) for x in (name, r["doc_id"], None if r["text"] is None else len(r["text"])) if x is not None)
    nothing = stage[1](spark, docs.limit(0), "/root/testdata/sf0.001")
    assert nothing.columns == docs.columns and nothing.collect() == []


def test_shards_of_odd_and_empty_tables(spark, odd, empty):
    rows = corpus_pipeline.shards(spark, odd, "").collect()
    assert len(rows) == odd.count()
    assert corpus_pipeline.shards(spark, empty, "").collect() == []
