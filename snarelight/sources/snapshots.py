"""Snapshots: each run writes new table folders, then announces them in the manifest.

A version is one manifest file. It is written whole under a name of its own and then given its
number, which only one run can do; readers follow the highest number, so they see all tables of a run or
none, and no job overwrites files it reads. A run that dies leaves folders that nothing refers to.

A run that finds its number taken looks at what was announced since the version it started from: if that
touches none of the tables it changes (or says it has read), its changes go on top of it; otherwise
it fails with ``ConcurrentChange`` and removes its folders.

A table is a folder of all its rows, or such a folder and change sets after it: rows added and the ids of rows
deleted, each set as large as the change. Reading applies them in one pass; ``MOST_CHANGES`` sets are
merged into a new folder by the run that would write one more.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snarelight.model import IDS, SCHEMAS, Tables
from snarelight.operators.skew import lookup_join
from snarelight.session import shared_path, stored

MOST_CHANGES = 16
_MANIFEST = (
    "version bigint, folders map<string,string>, changes map<string,array<struct<added:string,deleted:string>>>, "
    "last_ids map<string,bigint>, touched array<string>"
)


class ConcurrentChange(RuntimeError):
    """Another run has announced changes to the same tables first."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    folders: dict[str, str] = field(default_factory=dict)
    #: Per table: change sets in order, each the folders of rows added and of ids deleted.
    changes: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    last_ids: dict[str, int] = field(default_factory=dict)
    touched: frozenset[str] = frozenset()


def _manifest(root: str, number: int) -> str:
    return f"{root}/manifest/{number}.json"


def _read(spark: SparkSession, root: str, number: int) -> Version:
    row = spark.read.schema(_MANIFEST).json(_manifest(root, number)).first()
    changes = {name: [(c.added, c.deleted) for c in sets] for name, sets in (row.changes or {}).items()}
    return Version(row.version, dict(row.folders), changes, dict(row.last_ids), frozenset(row.touched or []))


def _latest(spark: SparkSession, root: str) -> Version | None:
    path, files = shared_path(spark, f"{root}/manifest")
    if not files.exists(path):
        return None
    names = [f.getPath().getName() for f in files.listStatus(path)]
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()]
    return _read(spark, root, max(numbers)) if numbers else None


def create_if_absent(spark: SparkSession, name: str, text: str) -> bool:
    """Creates the file whole, or not at all if there is one of that name.

    A rename that doesn't overwrite decides between two runs; on a local disk, where renames overwrite, a hard link does.
    An object store needs a committer whose renames don't overwrite.
    """
    jvm = spark.sparkContext._jvm
    target, files = shared_path(spark, name)
    files.mkdirs(target.getParent())
    own, _ = shared_path(spark, f"{target.getParent().toString()}/_{uuid4().hex}.tmp")
    out = files.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if files.getScheme() == "file":
            local = lambda path: jvm.java.nio.file.Paths.get(files.makeQualified(path).toUri())
            jvm.java.nio.file.Files.createLink(local(target), local(own))
        else:
            # No option: neither an existing target nor a half-written one is replaced.
            options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(files.makeQualified(own), files.makeQualified(target), options)
        return True
    except Py4JJavaError:
        if files.exists(target):
            return False
        raise
    finally:
        files.delete(own, False)


def _announce(spark: SparkSession, root: str, entry: Version) -> bool:
    changes = {name: [{"added": a, "deleted": d} for a, d in sets] for name, sets in entry.changes.items()}
    row = (entry.number, entry.folders, changes, entry.last_ids, sorted(entry.touched))
    text = spark.createDataFrame([row], _MANIFEST).select(F.to_json(F.struct("*")).alias("line")).first().line
    return create_if_absent(spark, _manifest(root, entry.number), text)


def _commit(tables: Tables, root: str, run: str, base: Version, entry: Version, reads: Collection[str], written: dict) -> int:
    """Announces ``entry`` on top of ``base`` or of what has been announced since.

    ``written`` has for each touched table its new folder (str) or its new change set (pair of folders).
    """
    spark, tip = tables.spark, base
    watched = set(written) | set(reads)
    while True:
        folders, changes = dict(tip.folders), dict(tip.changes)
        for name, what in written.items():
            if isinstance(what, str):
                folders[name] = what
                changes.pop(name, None)
            else:
                changes[name] = [*changes.get(name, []), what]
        last_ids = {n: max(tip.last_ids.get(n, 0), entry.last_ids.get(n, 0)) for n in {*tip.last_ids, *entry.last_ids}}
        if _announce(spark, root, Version(tip.number + 1, folders, changes, last_ids, frozenset(written))):
            return tip.number + 1
        tip = _read(spark, root, tip.number + 1)
        if clash := watched & tip.touched:
            path, files = shared_path(spark, f"{root}/{run}")
            files.delete(path, True)
            raise ConcurrentChange(f"version {tip.number} changed {', '.join(sorted(clash))} after version {base.number}")


def _base(tables: Tables, root: str) -> Version | None:
    """The version the tables were loaded from; for tables from elsewhere, the newest."""
    if tables.version is not None:
        return _read(tables.spark, root, tables.version)
    return _latest(tables.spark, root)


def _highest(df: DataFrame, name: str) -> int:
    return df.agg(F.max(IDS[name])).first()[0] or 0


def save(tables: Tables, root: str, changed: list[str] | None = None, reads: Collection[str] = ()) -> int:
    """Writes the changed tables (default: all) whole and returns the new version.

    ``reads`` names tables whose change by another run makes this one fail as well.
    """
    base = _base(tables, root)
    names = changed if changed is not None and base else Tables.names()
    run, written, last_ids = f"run-{uuid4().hex}", {}, {}
    for name in names:
        folder = f"{root}/{run}/{name}"
        getattr(tables, name).write.parquet(folder)
        written[name] = folder
        # Ids of deleted rows stay used: the mark never goes down.
        last_ids[name] = max(_highest(tables.spark.read.schema(SCHEMAS[name]).parquet(folder), name), tables.last_ids.get(name, 0))
    return _commit(tables, root, run, base or Version(), Version(last_ids=last_ids), reads, written)


def difference(before: DataFrame, after: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``after`` that are new or not as before, and the ids of rows of ``before`` that are gone or not the same."""
    key, columns = IDS[name], SCHEMAS[name].names
    old = before.select(F.col(key).alias("_old"), F.struct(*columns).alias("_before"))
    new = after.select(F.col(key).alias("_new"), F.struct(*columns).alias("_after"))
    both = old.join(new, F.col("_old") == F.col("_new"), "full")
    apart = stored(both.where(~F.col("_before").eqNullSafe(F.col("_after"))), "difference")
    return apart.where("_after is not null").select("_after.*"), apart.where("_before is not null").select(F.col("_old").alias(key))


def save_changes(before: Tables, after: Tables, root: str, changed: list[str], reads: Collection[str] = ()) -> int:
    """Writes what ``after`` has otherwise than ``before`` (as loaded) as change sets: as many rows as have changed."""
    base = _base(before, root)
    if base is None:
        raise FileNotFoundError(f"no snapshot under {root}")
    spark, run, written, last_ids = before.spark, f"run-{uuid4().hex}", {}, {}
    for name in changed:
        table = getattr(after, name)
        if len(base.changes.get(name, [])) >= MOST_CHANGES:
            written[name] = f"{root}/{run}/{name}"
            table.write.parquet(written[name])
            highest = _highest(spark.read.schema(SCHEMAS[name]).parquet(written[name]), name)
        else:
            added, deleted = difference(getattr(before, name), table, name)
            written[name] = (f"{root}/{run}/{name}-added", f"{root}/{run}/{name}-deleted")
            added.write.parquet(written[name][0])
            deleted.write.parquet(written[name][1])
            highest = _highest(added, name)
        last_ids[name] = max(highest, after.last_ids.get(name, 0))
    return _commit(before, root, run, base, Version(last_ids=last_ids), reads, written)


def _table(spark: SparkSession, entry: Version, name: str) -> DataFrame:
    """The rows of the folder and of all change sets that no later set deletes: one join, however many sets."""
    read = lambda folder: spark.read.schema(SCHEMAS[name]).parquet(folder)
    rows, sets = read(entry.folders[name]), entry.changes.get(name, [])
    if not sets:
        return rows
    key = IDS[name]
    rows = rows.withColumn("_set", F.lit(0))
    deleted = None
    for number, (added, gone) in enumerate(sets, 1):
        rows = rows.unionByName(read(added).withColumn("_set", F.lit(number)))
        ids = spark.read.schema(f"{key} bigint").parquet(gone).withColumn("_gone", F.lit(number))
        deleted = ids if deleted is None else deleted.unionByName(ids)
    last = deleted.groupBy(key).agg(F.max("_gone").alias("_gone"))
    live = lookup_join(rows, last, [key], "left").where(F.col("_gone").isNull() | (F.col("_gone") <= F.col("_set")))
    return live.select(*SCHEMAS[name].names)


def load(spark: SparkSession, root: str, version: int | None = None) -> tuple[Tables, dict[str, int]]:
    """The newest tables (or those of ``version``) and the highest id ever used in each."""
    entry = _latest(spark, root) if version is None else _read(spark, root, version)
    if entry is None:
        raise FileNotFoundError(f"no snapshot under {root}")
    last_ids = dict(entry.last_ids)
    return Tables(**{name: _table(spark, entry, name) for name in Tables.names()}, last_ids=last_ids, version=entry.number), last_ids
