"""The seven triage tables: schemas and the bundle that jobs take as input."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Codes stored in the tables.
PHISHING = "PHISHING"
LEGITIMATE = "LEGITIMATE"
SUSPICIOUS = "SUSPICIOUS"
ROLES = ("admin", "analyst", "user")
RULE_TYPES = ("keyword", "regex", "domain", "length", "tld", "other")
RISK_LEVELS = ("low", "medium", "high", "critical")
VOTE_VALUES = (-1, 1)

_LONG, _INT, _TEXT = T.LongType(), T.IntegerType(), T.StringType()
_REAL, _TIME = T.DoubleType(), T.TimestampNTZType()


def _schema(*columns: tuple) -> T.StructType:
    """Columns as (name, type) or (name, type, True) where NULL is allowed."""
    return T.StructType([T.StructField(c[0], c[1], len(c) > 2) for c in columns])


SCHEMAS: dict[str, T.StructType] = {
    "users": _schema(
        ("user_id", _LONG), ("name", _TEXT), ("email", _TEXT), ("role", _TEXT), ("created_at", _TIME)
    ),
    "url_submissions": _schema(
        ("url_id", _LONG),
        ("user_id", _LONG),
        ("url", _TEXT),
        ("url_domain", _TEXT),
        ("tld", _TEXT, True),
        ("result_code", _TEXT, True),
        ("created_at", _TIME),
        ("updated_at", _TIME, True),
    ),
    "rules": _schema(
        ("rule_id", _LONG),
        ("rule_name", _TEXT),
        ("description", _TEXT, True),
        ("pattern", _TEXT, True),
        ("rule_type", _TEXT, True),
        ("risk_level", _TEXT, True),
        ("tld", _TEXT, True),
    ),
    "url_rule_matches": _schema(
        ("match_id", _LONG),
        ("url_id", _LONG),
        ("rule_id", _LONG),
        ("match_details", _TEXT, True),
        ("matched_at", _TIME),
    ),
    "statuses": _schema(
        ("status_id", _LONG),
        ("url_id", _LONG),
        ("reviewer_id", _LONG, True),
        ("result_code", _TEXT),
        ("label", _TEXT),
        ("description", _TEXT, True),
        ("created_at", _TIME),
    ),
    "votes": _schema(
        ("vote_id", _LONG), ("user_id", _LONG), ("url_id", _LONG), ("vote_value", _INT), ("created_at", _TIME)
    ),
    "url_score_comparisons": _schema(
        ("rep_id", _LONG),
        ("url_id", _LONG),
        ("external_source", _TEXT, True),
        ("avg_score", _REAL, True),
        ("online_score", _REAL, True),
        ("risk_level", _TEXT, True),
        ("created_at", _TIME),
    ),
}


IDS = {
    "users": "user_id",
    "url_submissions": "url_id",
    "rules": "rule_id",
    "url_rule_matches": "match_id",
    "statuses": "status_id",
    "votes": "vote_id",
    "url_score_comparisons": "rep_id",
}


@dataclass(frozen=True)
class Tables:
    """One consistent snapshot of the seven tables.

    ``last_ids`` has the highest id ever given out in a table, where rows have been deleted
    since: ids are never given out again. ``version`` is that of the snapshot they were loaded from.
    """

    users: DataFrame
    url_submissions: DataFrame
    rules: DataFrame
    url_rule_matches: DataFrame
    statuses: DataFrame
    votes: DataFrame
    url_score_comparisons: DataFrame
    last_ids: Mapping[str, int] = field(default_factory=dict)
    version: int | None = None

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls) if f.name not in ("last_ids", "version")]

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "Tables":
        return cls(**{n: spark.read.schema(SCHEMAS[n]).parquet(f"{root}/{n}") for n in cls.names()})

    @property
    def spark(self) -> SparkSession:
        return self.users.sparkSession

    def last_id(self, name: str) -> int:
        """The highest id ever given out in a table."""
        highest = getattr(self, name).agg(F.max(IDS[name])).first()[0] or 0
        return max(highest, self.last_ids.get(name, 0))

    def remembering(self, *names: str) -> "Tables":
        """The same tables with their last ids noted (default: of all): to be called before rows are deleted."""
        return replace(self, last_ids={**self.last_ids, **{n: self.last_id(n) for n in names or self.names()}})

    def with_tables(self, **changed: DataFrame) -> "Tables":
        return replace(self, **changed)
