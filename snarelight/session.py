"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the jobs rely on.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster leave
    them to the submit command.
    """
    builder = (
        SparkSession.builder.appName("snarelight")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, reachable by all executors.

    The cluster names it in ``spark.checkpoint.dir``. Only a single-machine session
    without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="snarelight-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str):
    """A path and its file system, as Spark's own readers and writers reach it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_folder(spark: SparkSession, label: str) -> str:
    folder = f"{shared_folder(spark)}/{label}-{uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(folder)
    return folder


@contextmanager
def temporary_folders(spark: SparkSession) -> Iterator[None]:
    """Removes, at the end of the block, the intermediate tables made in it.

    Results are lazy and read those tables, so they have to be written or collected inside the block.
    """
    token = _made.set([])
    try:
        yield
    finally:
        folders = _made.get() or []
        _made.reset(token)
        for folder in folders:
            path, files = shared_path(spark, folder)
            files.delete(path, True)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Runtime settings of the session for the block (``_`` in a name for a dot); lazy results run later, without them."""
    names = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written once and read back: computed once, whoever reads it and however often.

    Unlike a cached DataFrame it survives lost executors, and later reads take only the
    columns they need and know the table's true size. The shuffle files of the write go with it:
    nothing reads them again, and Spark would keep them until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    folder = new_folder(spark, label)
    with settings(spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true"):
        df.write.options(**options).parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out.stored_in = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables, as ``stored`` gave them, that nothing reads again."""
    for table in tables:
        path, files = shared_path(table.sparkSession, table.stored_in)
        files.delete(path, True)
