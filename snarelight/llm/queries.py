"""One query per text operator: applies it to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snarelight.llm import chat, decontaminate, embeddings, jaccard, lm, mixing, periodic, personal, quality, repeats, secrets, sharding, spelling
from snarelight.llm.common import WORD, table
from snarelight.llm.oracles import ORACLES


def _count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _written(spans: Column | str) -> Column:
    """kind:start:end, comma-joined."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    counts = [_count_of("base_spans", k).alias(f"n_{k}") for k in personal.KINDS]
    digest = F.sha2(_written("base_spans").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, _written("spans").alias("spans"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]).drop("removed")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    counts = [_count_of("spans", k).alias(f"n_{k}") for k in secrets.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written("spans").alias("spans")
    )


def op5_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 24, keep=["doc_id"])


#: Added to the conversations: control strings inside texts.
ESCAPE_TEST = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(ESCAPE_TEST, "conv_id bigint, turn bigint, role string, text string")
    ranks = secrets.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return chat.read_back(*chat.format_chats(given.unionByName(extra), ranks, public_tokenizers.PATTERN))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality.METRICS, "base_failed", "kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = mixing.mix_report(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return report.select("doc_id", "size", "source_size", "target", "taken", "copies")


#: Every so many (document, word) pairs are misspelled before words are counted.
MISSPELLED = 97


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(docs, doc_id="doc_id", change=spelling.drop_letter(MISSPELLED))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), keep=["vec_id"])


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id and text) with the words of every tenth id's text (by hash) made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = docs.withColumn("_g", F.floor(h / 10)).withColumn("_words", F.when(h % 10 == 0, words))
    n, g = F.size("_words"), F.col("_g")
    rows = rows.withColumn("_a", F.when(n > 0, (g % n).cast("int")))
    a = F.col("_a")
    rows = rows.withColumn("_p", F.when(n > 0, (1 + F.floor((n - a) / (3 + g % 8))).cast("int")))
    at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % F.col("_p"))
    changed = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_words", at(i))), " ")
    return rows.select("doc_id", F.when(n > 0, changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.find_runs(docs, keep=["doc_id"])
    lines = F.transform(
        "runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    )
    written = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))

    def better(best: Column, r: Column) -> Column:
        # Products of whole numbers compare the quotients exactly; runs come by start, then period.
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    rows = found.withColumn("_best", F.aggregate("runs", none, better))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(written.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_personal_data": op2_personal_data,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_secrets": op4_secrets,
    "op5_suffix_tree_lm": op5_suffix_tree_lm,
    "op6_sharding": op6_sharding,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}

__all__ = ["ORACLES", "QUERIES"]
