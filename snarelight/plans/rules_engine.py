"""Matching submissions against the rule catalogue, by rule type.

``tld`` and ``domain`` rules are equi-joins, ``length`` rules one test; only ``keyword`` and ``regex``
rules are patterns that each URL is tested with.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snarelight.model import Tables
from snarelight.operators.catalogue import with_catalogue
from snarelight.operators.skew import lookup_join

LONG_URL = 75  # our threshold; the catalogue states none
PATTERNS_PER_PASS = 200
_PATTERNED = ("keyword", "regex")


def _note(shown: Column) -> Column:
    return F.concat(F.lit("Matched "), F.col("rule_type"), F.lit(" rule: "), shown).alias("match_details")


def _compiles(spark: SparkSession, pattern: str) -> bool:
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile("(?i)" + pattern)
    except IllegalArgumentException:
        return False
    return True


def bad_patterns(rules: DataFrame) -> DataFrame:
    """(rule_id, pattern) of the rules that can't be compiled; matching goes on without them."""
    spark = rules.sparkSession
    patterned = rules.where(F.col("rule_type").isin(*_PATTERNED) & F.col("pattern").isNotNull())
    bad = [(r.rule_id, r.pattern) for r in patterned.toLocalIterator() if not _compiles(spark, r.pattern)]
    return spark.createDataFrame(bad, "rule_id bigint, pattern string")


def _by_key(source: DataFrame, rules: DataFrame, column: str, key: Column, shown: Column) -> DataFrame:
    """URLs whose ``column`` equals the rules' ``key``."""
    keyed = rules.where(key.isNotNull()).groupBy(key.alias(column)).agg(
        F.collect_list(F.struct("rule_id", _note(shown))).alias("_found")
    )
    return lookup_join(source.select("url_id", column), keyed, [column], "inner", ["url_id"]).select("url_id", F.inline("_found"))


def _by_pattern(source: DataFrame, rules: DataFrame, patterns_per_pass: int) -> list[DataFrame]:
    """One narrow pass over the URLs for each ``patterns_per_pass`` rules; patterns are compiled once a task."""
    passes, entries = [], []
    spark = rules.sparkSession
    for rule in rules.where(F.col("pattern").isNotNull()).orderBy("rule_id").toLocalIterator():
        if not _compiles(spark, rule.pattern):
            continue
        pattern = "(?i)" + rule.pattern
        note = F.lit(f"Matched {rule.rule_type} rule: {rule.pattern}").alias("match_details")
        found = F.struct(F.lit(rule.rule_id).cast("bigint").alias("rule_id"), note)
        entries.append(F.when(F.col("url").rlike(pattern) | F.col("url_domain").rlike(pattern), found))
    for at in range(0, len(entries), patterns_per_pass):
        hits = F.array_compact(F.array(*entries[at : at + patterns_per_pass]))
        passes.append(source.select("url_id", F.inline(hits)))
    return passes


def rule_hits(
    urls: DataFrame, rules: DataFrame, long_url: int = LONG_URL, patterns_per_pass: int = PATTERNS_PER_PASS
) -> DataFrame:
    """(url_id, rule_id, match_details) for every rule a URL meets.

    The plan has three parts whatever the catalogue's size, and one more for each
    ``patterns_per_pass`` pattern rules. Rules with a broken pattern match nothing (``bad_patterns``).
    """
    source = urls.select("url_id", "url", "url_domain", "tld")
    listed = rules.select("rule_id", "pattern", "rule_type", "tld")
    of_type = lambda name: listed.where(F.col("rule_type") == name)
    lengths = of_type("length").select("rule_id", _note(F.lit(f"more than {long_url} characters")))
    parts = [
        _by_key(source, of_type("tld"), "tld", F.col("tld"), F.col("tld")),
        _by_key(source, of_type("domain"), "url_domain", F.lower("pattern"), F.col("pattern")),
        with_catalogue(source.where(F.length("url") > long_url), lengths, "_found").select("url_id", F.inline("_found")),
        *_by_pattern(source, listed.where(F.col("rule_type").isin(*_PATTERNED)), patterns_per_pass),
    ]
    return reduce(DataFrame.unionByName, parts)


def evaluate_rules(tables: Tables, long_url: int = LONG_URL) -> DataFrame:
    """The matches to add: hits that are not stored yet."""
    return rule_hits(tables.url_submissions, tables.rules, long_url).join(
        tables.url_rule_matches.select("url_id", "rule_id"), ["url_id", "rule_id"], "left_anti"
    )
