"""Constraint audit: keys, value lists, required columns and references.

Spark enforces none of them. Rows are counted with a map-side combine, so no check brings the
rows of one key together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snarelight.model import RISK_LEVELS, ROLES, RULE_TYPES, SCHEMAS, VOTE_VALUES, Tables
from snarelight.operators.skew import dealt, parts_for

UNIQUE = [
    ("users", ["user_id"]),
    ("users", ["email"]),
    ("url_submissions", ["url_id"]),
    ("url_submissions", ["url"]),
    ("rules", ["rule_id"]),
    ("rules", ["rule_name"]),
    ("url_rule_matches", ["match_id"]),
    ("url_rule_matches", ["url_id", "rule_id"]),
    ("statuses", ["status_id"]),
    ("votes", ["vote_id"]),
    ("votes", ["user_id", "url_id"]),
    ("url_score_comparisons", ["rep_id"]),
]
ALLOWED = [
    ("users", "role", ROLES),
    ("rules", "rule_type", RULE_TYPES),
    ("rules", "risk_level", RISK_LEVELS),
    ("votes", "vote_value", VOTE_VALUES),
    ("url_score_comparisons", "risk_level", RISK_LEVELS),
]
REFERENCES = [
    ("url_submissions", "user_id", "users", "user_id"),
    ("url_rule_matches", "url_id", "url_submissions", "url_id"),
    ("url_rule_matches", "rule_id", "rules", "rule_id"),
    ("statuses", "url_id", "url_submissions", "url_id"),
    ("statuses", "reviewer_id", "users", "user_id"),
    ("votes", "user_id", "users", "user_id"),
    ("votes", "url_id", "url_submissions", "url_id"),
    ("url_score_comparisons", "url_id", "url_submissions", "url_id"),
]


_BAD = "bad"
_OWN = "own"


def _constraints() -> list[tuple[str, str, str, str, str]]:
    """(table, check, columns, domain, role): a domain is a key, or the rows that break a row check."""
    out = [(t, "unique", ",".join(c), f"{t}:{','.join(c)}", _OWN) for t, c in UNIQUE]
    out += [(t, "required", f.name, f"{t} required {f.name}", _BAD) for t, s in SCHEMAS.items() for f in s if not f.nullable]
    out += [(t, "allowed", c, f"{t} allowed {c}", _BAD) for t, c, _ in ALLOWED]
    return out + [(t, "reference", c, f"{target}:{key}", f"{t}.{c}") for t, c, target, key in REFERENCES]


#: Rows of a table that one task turns into entries, several each.
TASK_ROWS = 500_000
#: Domains as numbers, keys first, and their roles as numbers within the domain: a group's state is a few longs.
_ROLES: dict[str, list[str]] = {}
for *_, _domain, _role in sorted(_constraints(), key=lambda c: c[4] == _BAD):
    _ROLES.setdefault(_domain, []).append(_role)
_DOMAINS = {domain: i for i, domain in enumerate(_ROLES)}
_SLOTS = max(map(len, _ROLES.values()))
_KEYS = sum(roles != [_BAD] for roles in _ROLES.values())


def _entry(domain: str, role: str, columns: list[str]) -> Column:
    keys = [F.col(c).cast("string") for c in columns] + [F.lit(None).cast("string")] * (2 - len(columns))
    numbers = [F.lit(_DOMAINS[domain]).alias("domain"), F.lit(_ROLES[domain].index(role)).alias("role")]
    return F.struct(*numbers, keys[0].alias("k1"), keys[1].alias("k2"))


def _entries(tables: Tables, table: str, task_rows: int) -> DataFrame:
    """What one scan of a table has to say: its keys, its references and its bad values."""
    entries = [_entry(f"{t}:{','.join(c)}", _OWN, c) for t, c in UNIQUE if t == table]
    entries += [
        F.when(F.col(c).isNotNull(), _entry(f"{target}:{key}", f"{t}.{c}", [c])) for t, c, target, key in REFERENCES if t == table
    ]
    checks = [("required", f.name, F.col(f.name).isNull()) for f in SCHEMAS[table] if not f.nullable]
    checks += [("allowed", c, ~F.col(c).isin(*values)) for t, c, values in ALLOWED if t == table]
    entries += [F.when(bad, _entry(f"{table} {kind} {c}", _BAD, [])) for kind, c, bad in checks]
    used = {f.name for f in SCHEMAS[table] if not f.nullable}
    used |= {c for t, cs in UNIQUE if t == table for c in cs} | {c for t, c, *_ in [*ALLOWED, *REFERENCES] if t == table}
    rows = getattr(tables, table).select(*sorted(used))
    rows = dealt(rows, rows.columns, parts_for(rows, task_rows=task_rows))
    return rows.select(F.inline(F.array_compact(F.array(*entries))))


def integrity_audit(tables: Tables, task_rows: int = TASK_ROWS) -> DataFrame:
    """One row per constraint with the number of violations.

    unique: surplus copies; allowed: rows with another value; required: rows with NULL;
    reference: rows that point nowhere.

    Each table is scanned once, after a count where it is large: nearly every key is a group of its own in the
    map-side combine, so a task gets ``task_rows`` rows of a table. All keys and all references to them are counted
    in one aggregation: a key with a count of its own and one per referencing column shows surplus copies and
    dangling references alike.
    """
    entries = reduce(DataFrame.unionByName, [_entries(tables, name, task_rows) for name in SCHEMAS])
    counts = entries.groupBy("domain", "k1", "k2").agg(*[F.count_if(F.col("role") == i).alias(f"n{i}") for i in range(_SLOTS)])
    found = [F.when(F.col("domain") < _KEYS, F.greatest(F.col("n0") - 1, F.lit(0))).otherwise(F.col("n0"))]
    found += [F.when(F.col("n0") == 0, F.col(f"n{i}")).otherwise(F.lit(0)) for i in range(1, _SLOTS)]
    per_role = [F.struct(F.lit(i).alias("role"), F.sum(f).alias("violations")) for i, f in enumerate(found)]
    totals = counts.groupBy("domain").agg(F.array(*per_role).alias("totals")).select("domain", F.inline("totals"))
    names = ["table_name", "check_name", "column_names", "domain", "role"]
    numbered = [(*c[:3], _DOMAINS[c[3]], _ROLES[c[3]].index(c[4])) for c in _constraints()]
    listed = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, c, strict=True)]) for c in numbered]
    constraints = tables.spark.range(1).select(F.inline(F.array(*listed)))
    # Both sides have a row per constraint at most.
    return constraints.join(F.broadcast(totals), ["domain", "role"], "left").select(
        "table_name", "check_name", "column_names", F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations")
    )
