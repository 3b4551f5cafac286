"""Every registered query against its DuckDB statement, and the plans that matter at scale."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from snarelight.driver.queries import QUERIES
from snarelight.driver.tables import AS_OF, input_rows, triage_tables
from snarelight.operators import voting
from snarelight.plans import audit, intake, maintenance, reports, rules_engine, search

SF_DIR = "/root/testdata/sf0.001"
DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in DRIVER_TABLES:
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def comparable(names, data):
    def plain(value):
        if isinstance(value, float):
            return None if math.isnan(value) else round(value, 9)
        return value

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    result = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert comparable(df.columns, df.collect()) == comparable(names, result.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return triage_tables(spark, SF_DIR)


def test_no_cross_joins_and_no_single_task_windows(tables):
    builders = [
        reports.vote_conflicts, reports.url_analysis_report, reports.risk_categories, reports.url_listing, reports.rule_effectiveness,
        lambda t: maintenance.recompute_scores(t).tables.url_score_comparisons,
        lambda t: maintenance.cleanup_inactive(t, AS_OF).tables.url_submissions,
        rules_engine.evaluate_rules, search.url_dossier, lambda t: reports.risk_rankings(t, None),
    ]
    for build in builders:
        text = plan(build(tables))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, build


def test_scan_reads_needed_columns_only(tables):
    text = plan(reports.result_counts(tables))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text


def test_python_is_not_in_the_plans(spark, tables):
    log = spark.createDataFrame([], "event_id bigint, ts timestamp_ntz, user_id bigint, url_id bigint, vote_value int")
    for df in (voting.fold_votes(log), rules_engine.evaluate_rules(tables), reports.url_listing(tables)):
        assert "Python" not in plan(df.where(F.lit(True)))


def test_audit_scans_each_table_once(tables):
    text = plan(audit.integrity_audit(tables))
    assert text.count("FileScan") <= 9 and text.count("Exchange") <= 25


def test_requests_are_checked_once_and_stored(spark, tables):
    for build, kind in (
        (intake.submit_urls, "requests"), (intake.register_users, "account_requests"), (intake.add_rule_matches, "match_requests"),
    ):
        result = build(tables, input_rows(spark, SF_DIR, kind))
        assert "checked-" in plan(result.rejected) and "events" not in plan(result.rejected)
