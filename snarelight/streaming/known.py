"""The URLs known so far, in hash buckets.

Known before the stream: one base, written when the stream first starts. Each batch adds its URLs as a
segment of a level store. A lookup reads only the buckets that its URLs fall into, whatever the number of
URLs and batches; only rows with an equal digest and URL are found.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snarelight.operators.skew import lookup_join
from snarelight.session import shared_path
from snarelight.streaming.levels import FAN, LevelStore

BUCKETS = 64
_ROW = "digest bigint, url string, bucket int"


class KnownUrls:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, fan: int = FAN) -> None:
        self.spark, self.root, self.buckets = spark, root, buckets
        self.added = LevelStore(spark, f"{root}/added", _ROW, self._merged, fan, by="bucket")

    def _keyed(self, urls: DataFrame) -> DataFrame:
        digest = F.xxhash64("url")
        return urls.select(digest.alias("digest"), "url", F.pmod(digest, F.lit(self.buckets)).cast("int").alias("bucket"))

    @staticmethod
    def _dealt(rows: DataFrame) -> DataFrame:
        # Evens out what tasks write: small buckets share a task, large ones are split.
        return rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "digest")

    def _merged(self, rows: DataFrame) -> DataFrame:
        return self._dealt(rows.select("digest", "url", "bucket"))

    def start(self, urls: DataFrame) -> None:
        """Writes the base, unless an earlier start of the stream has."""
        done, files = shared_path(self.spark, f"{self.root}/base/_SUCCESS")
        if not files.exists(done):
            self._dealt(self._keyed(urls.select("url"))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/base")

    def add(self, urls: DataFrame, batch: int) -> None:
        self.added.write(self._dealt(self._keyed(urls.select("url"))), batch)

    def stored(self, urls: DataFrame, batch: int) -> DataFrame:
        """digest, url and bucket of all stored rows in the buckets of ``urls`` (at most ``buckets`` numbers are collected)."""
        wanted = [r[0] for r in self._keyed(urls).select("bucket").distinct().collect()]
        rows = self.added.read(batch, wanted).drop("segment")
        if not wanted:
            return rows
        try:
            base = self.spark.read.schema(_ROW).option("basePath", f"{self.root}/base").parquet(
                f"{self.root}/base/bucket={{{','.join(map(str, sorted(wanted)))}}}"
            )
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return rows
            raise
        return base.unionByName(rows)

    def among(self, urls: DataFrame, batch: int) -> DataFrame:
        """Those of ``urls`` (column url) that were known before ``batch``."""
        asked = self._keyed(urls.select("url").where("url is not null").distinct())
        return lookup_join(self.stored(urls, batch), asked, ["bucket", "digest", "url"], "left_semi").select("url")
