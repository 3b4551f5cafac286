"""Jobs that group or sort many narrow rows deal them by number, with the same results."""

import time

import pytest
from pyspark.sql import functions as F

from helpers import rows
from snarelight import session
from snarelight.model import SCHEMAS
from snarelight.plans import audit, intake


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture()
def broken(seed, spark):
    """Copies, dangling references, NULLs and wrong values in the seed."""
    votes = seed.votes.unionByName(seed.votes.limit(2)).withColumn("url_id", F.expr("if(vote_id = 3, 999, url_id)"))
    users = seed.users.withColumn("role", F.expr("if(user_id = 2, 'boss', role)")).withColumn("email", F.lit(None).cast("string"))
    return seed.with_tables(votes=votes, users=users)


def test_audit_deals_rows(broken):
    whole, dealt = audit.integrity_audit(broken), audit.integrity_audit(broken, task_rows=3)
    assert sorted(rows(dealt)) == sorted(rows(whole)) and any(r.violations for r in whole.collect())
    assert "REPARTITION_BY_NUM" in plan(dealt) and "REPARTITION_BY_NUM" not in plan(whole)


def test_audit_groups_hold_few_counters():
    referenced = [sum(c[3] == target for c in audit._constraints()) for target in {c[3] for c in audit._constraints()}]
    assert audit._SLOTS == max(referenced) == 5
    assert len(audit._DOMAINS) == len({c[3] for c in audit._constraints()}) and set(SCHEMAS) == {c[0] for c in audit._constraints()}


def test_removal_deals_both_sides(spark, seed):
    asked = spark.createDataFrame([(1, 1), (1, 1), (2, 3), (99, 1), (5, 3)], "match_id bigint, url_id bigint")
    whole, dealt = intake.remove_rule_matches(seed, asked), intake.remove_rule_matches(seed, asked, task_rows=3)
    kept = [x.tables.url_rule_matches.select("match_id", "url_id") for x in (whole, dealt)]
    assert sorted(rows(kept[0])) == sorted(rows(kept[1]))
    assert sorted(rows(dealt.problems)) == sorted(rows(whole.problems)) == [(2, 3), (99, 1)]
    assert dealt.rows_affected() == whole.rows_affected() == 2
    assert "REPARTITION_BY_NUM" in plan(dealt.problems)


def test_stored_tables_leave_no_shuffle_files(spark):
    """What a stored table was made from goes with its write, and a discarded table is gone."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {n for n in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in n}
    before, name = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name, None)
    table = session.stored(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count(), "left")
    end = time.monotonic() + 20
    while files() - before and time.monotonic() < end:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(name, None) == setting
    assert table.count() == 1000
    session.discard(table)
    path, system = session.shared_path(spark, table.stored_in)
    assert not system.exists(path)
