"""The maintenance jobs by name, as an operator runs them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snarelight.model import Tables
from snarelight.plans import feed as feed_jobs
from snarelight.plans import intake, maintenance, rules_engine
from snarelight.plans.maintenance import Change

# Job names and the labels used in their messages.
LABELS = {
    "reclassify_votes": "Apply vote-driven classification",
    "recompute_scores": "Recalculate blended risk scores",
    "cleanup_urls": "Remove inactive submissions",
    "cleanup_rule_matches": "Clean orphaned rule matches",
    "promote_users": "Promote active reporters",
    "auto_classify_pending": "Auto-classify pending URLs",
    "import_urlhaus": "Import URLHaus feed",
}


def _table_jobs(as_of: datetime) -> dict[str, Callable[[Tables], Change]]:
    return {
        "reclassify_votes": lambda t: maintenance.reclassify_by_votes(t, as_of),
        "recompute_scores": maintenance.recompute_scores,
        "cleanup_urls": lambda t: maintenance.cleanup_inactive(t, as_of),
        "cleanup_rule_matches": maintenance.cleanup_rule_matches,
        "promote_users": maintenance.promote_users,
        "auto_classify_pending": lambda t: maintenance.auto_classify(t, as_of),
    }


def run_job(
    tables: Tables, name: str, as_of: datetime, feed: DataFrame | None = None, limit: int = feed_jobs.FEED_LIMIT
) -> tuple[Change, DataFrame]:
    """A job's new tables and its one-row report (action, rows_affected, message)."""
    if name not in LABELS:
        raise ValueError("Unknown maintenance task.")
    done = f"{LABELS[name]} complete."
    if name == "import_urlhaus":
        if feed is None:
            raise ValueError("the import needs a feed")
        imported = feed_jobs.feed_import(tables, feed, as_of, limit)
        report = imported.summary.select(
            F.lit(name).alias("action"),
            F.col("inserted").alias("rows_affected"),
            F.format_string(f"{done} Imported %d URLs (skipped %d).", "inserted", "skipped").alias("message"),
        )
        return feed_jobs.store_feed(tables, imported.inserted, as_of), report
    change = _table_jobs(as_of)[name](tables)
    return change, _report(name, change)


def _report(name: str, change: Change) -> DataFrame:
    counted = change.affected.agg(F.count(F.lit(1)).alias("rows_affected"))
    message = F.format_string(f"{LABELS[name]} complete. Rows affected: %d.", "rows_affected")
    return counted.select(F.lit(name).alias("action"), "rows_affected", message.alias("message"))


def job_reports(tables: Tables, as_of: datetime, feed: DataFrame) -> DataFrame:
    """What each of the seven jobs would report on these tables."""
    reports = [_report(name, job(tables)) for name, job in _table_jobs(as_of).items()]
    imported = feed_jobs.feed_import(tables, feed, as_of).summary.select(
        F.lit("import_urlhaus").alias("action"),
        F.col("inserted").alias("rows_affected"),
        F.format_string(
            f"{LABELS['import_urlhaus']} complete. Imported %d URLs (skipped %d).", "inserted", "skipped"
        ).alias("message"),
    )
    return reduce(DataFrame.unionByName, [*reports, imported])


def refresh_verdicts(tables: Tables, as_of: datetime) -> Tables:
    """Rules, then pending codes, then votes, then scores: each step builds on the one before."""
    tables = intake.store_matches(tables, rules_engine.evaluate_rules(tables), as_of).tables
    tables = maintenance.auto_classify(tables, as_of).tables
    tables = maintenance.reclassify_by_votes(tables, as_of).tables
    return maintenance.recompute_scores(tables).tables
