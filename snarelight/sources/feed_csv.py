"""Reading threat-feed CSV files with a header row."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snarelight.operators.positions import with_index

COLUMNS = ["url", "dateadded", "threat", "url_status", "tags", "last_online"]


def _options(multi_line: bool) -> dict:
    return {"header": True, "quote": '"', "escape": '"', "multiLine": multi_line, "encoding": "UTF-8"}


def _schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _picked(raw: DataFrame, *extra) -> DataFrame:
    """The used columns by name; a column the file lacks is NULL."""
    present = set(raw.columns)
    picked = [F.col(c) if c in present else F.lit(None).cast("string").alias(c) for c in COLUMNS]
    return raw.select(*extra, *picked)


def _files_by_header(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files under ``path`` by the columns of their header; one line of each is read here."""
    files = [r[0] for r in spark.read.format("binaryFile").load(path).select("path").toLocalIterator()]
    groups: dict[tuple[str, ...], list[str]] = {}
    for file in sorted(files):
        lines = spark.read.text(file).head(1)
        header = tuple(next(csv.reader([lines[0][0].removeprefix("\ufeff")]), [])) if lines else ()
        groups.setdefault(header, []).append(file)
    return groups


def _has_broken_lines(spark: SparkSession, files: list[str]) -> bool:
    """Whether a quoted value goes over a line break: some line then has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    return not spark.read.text(files).where(quotes % 2 == 1).isEmpty()


def read_feed(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Feed rows as text with ``seq``, their place in file-name and line order.

    Each file's own header names its columns. Files are split unless quoted values hold line
    breaks (looked up when ``multi_line`` is None), which makes a file one task.
    """
    parts = []
    for header, files in _files_by_header(spark, path).items():
        if not header:
            continue
        broken = _has_broken_lines(spark, files) if multi_line is None else multi_line
        raw = spark.read.schema(_schema(list(header))).options(**_options(broken), enforceSchema=False).csv(files)
        place = [
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_line"),
        ]
        parts.append(_picked(raw, *place))
    if not parts:
        return spark.createDataFrame([], _schema(COLUMNS)).select(F.lit(0).cast("bigint").alias("seq"), *COLUMNS)
    rows = reduce(DataFrame.unionByName, parts)
    return with_index(rows, [F.asc("_file"), F.asc("_block"), F.asc("_line")], "seq").select("seq", *COLUMNS)


def stream_feed_files(spark: SparkSession, folder: str, columns: list[str] = COLUMNS, multi_line: bool = True) -> DataFrame:
    """The same as a stream over a folder of files; ``columns`` is their header, in file order.

    A file with another header fails the stream instead of being read into wrong columns.
    """
    options = {**_options(multi_line), "enforceSchema": False}
    raw = spark.readStream.schema(_schema(columns)).options(**options).csv(folder)
    return _picked(raw)
