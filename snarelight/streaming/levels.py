"""Numbered batches kept as levels of merged segments.

A batch is written as a segment of its own. Whenever ``fan`` segments of one size are complete, they are
merged into one of ``fan`` times that size, so after n batches there are at most (fan - 1) segments for each of
the log(n) sizes, and each row has been rewritten at most once a size. Which segments are merged follows
from the batch number alone: a batch that runs again writes the same segments again. A merged segment's
parts are removed one compaction later, when no batch can be run again that would read them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snarelight.session import shared_path

FAN = 8
#: The first batch number of a row's segment.
SEGMENT = "segment"


class LevelStore:
    """``merge`` makes one segment of several: it gets their rows, with ``segment``, and drops that column."""

    def __init__(
        self, spark: SparkSession, root: str, schema: str, merge: Callable[[DataFrame], DataFrame], fan: int = FAN, by: str | None = None
    ) -> None:
        self.spark, self.root, self.schema, self.merge, self.fan, self.by = spark, root, schema, merge, fan, by

    def _folder(self, span: tuple[int, int]) -> str:
        return f"{self.root}/{SEGMENT}={span[0]}/upto={span[1]}"

    def _write(self, df: DataFrame, span: tuple[int, int]) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(self.by) if self.by else writer).parquet(self._folder(span))

    def spans(self) -> set[tuple[int, int]]:
        """The complete segments as (first batch, batch after the last)."""
        path, files = shared_path(self.spark, self.root)
        if not files.exists(path):
            return set()
        out = set()
        for first in files.listStatus(path):
            for upto in files.listStatus(first.getPath()):
                name = upto.getPath()
                if files.exists(shared_path(self.spark, f"{name.toString()}/_SUCCESS")[0]):
                    out.add((int(first.getPath().getName().partition("=")[2]), int(name.getName().partition("=")[2])))
        return out

    def cover(self, start: int, upto: int, most: int | None = None, spans: set[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
        """The largest complete segments (of at most ``most`` batches) that make up start..upto. Batches without one had no rows."""
        spans = self.spans() if spans is None else spans
        by_start: dict[int, list[int]] = {}
        for first, after in spans:
            by_start.setdefault(first, []).append(after)
        out, at = [], start
        while at < upto:
            fitting = [x for x in by_start.get(at, []) if x <= upto and (most is None or x - at <= most)]
            if fitting:
                out.append((at, max(fitting)))
            at = max(fitting, default=at + 1)
        return out

    def write(self, df: DataFrame, batch: int) -> None:
        self._write(df, (batch, batch + 1))

    def compact(self, upto: int) -> None:
        """Merges what is complete before batch ``upto``; to be called before that batch is written."""
        size, spans, merged = self.fan, self.spans(), False
        while upto and upto % size == 0:
            span = (upto - size, upto)
            if span not in spans:
                parts = self.cover(*span, most=size // self.fan, spans=spans)
                if parts:
                    self._write(self.merge(self._read(parts)), span)
                    spans.add(span)
                    merged = True
            size *= self.fan
        if merged:
            for first, after in spans:
                inside = any(a <= first and after <= b and b - a > after - first and b < upto for a, b in spans)
                if inside:
                    path, files = shared_path(self.spark, self._folder((first, after)))
                    files.delete(path, True)

    def _read(self, spans: list[tuple[int, int]], only: list[int] | None = None) -> DataFrame:
        columns = self.spark.createDataFrame([], self.schema).columns
        rows = None
        for span in spans:
            folder = self._folder(span)
            if only is not None:
                folder = f"{folder}/{self.by}={{{','.join(map(str, only))}}}"
            try:
                found = self.spark.read.schema(self.schema).option("basePath", self._folder(span)).parquet(folder)
            except AnalysisException as missing:
                if missing.getCondition() == "PATH_NOT_FOUND":
                    continue
                raise
            found = found.select(*columns, F.lit(span[0]).cast("bigint").alias(SEGMENT))
            rows = found if rows is None else rows.unionByName(found)
        return self.spark.createDataFrame([], f"{self.schema}, {SEGMENT} bigint") if rows is None else rows

    def read(self, upto: int | None = None, only: list[int] | None = None) -> DataFrame:
        """Rows of the batches before ``upto`` (default: all) with ``segment``; ``only`` names values of the column it is partitioned by."""
        spans = self.spans()
        last = max((after for _, after in spans), default=0) if upto is None else upto
        return self._read(self.cover(0, last, spans=spans), only)
