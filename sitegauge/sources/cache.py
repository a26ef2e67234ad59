"""Answers of lookups kept over runs.

Every run appends its new answers, hits and misses, as one batch; of several answers to a key the newest counts.  A batch
is seen only once its write was finished, so a run cut short leaves nothing behind that counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitegauge.session import small_table, stage
from sitegauge.sources import files

ENTRY = "key string, fips string"


class LookupCache:
    """Batches of (``key``, ``fips``) under ``folder``; a null ``fips`` is a known miss."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _path(self, batch: int) -> str:
        return f"{self.folder}/batch-{batch}"

    def batches(self) -> int:
        """Finished batches, one per run that found something new."""
        n = 0
        while files.finished(self.spark, self._path(n + 1)):
            n += 1
        return n

    def history(self) -> DataFrame:
        """All answers with the number of their batch."""
        parts = [self.spark.read.schema(ENTRY).parquet(self._path(b)).withColumn("batch", F.lit(b))
                 for b in range(1, self.batches() + 1)]
        return reduce(DataFrame.unionByName, parts) if parts else small_table(self.spark, [], ENTRY + ", batch int")

    def entries(self) -> DataFrame:
        """The newest answer to each key, and the batch it came with."""
        newest = self.history().groupBy("key").agg(F.max(F.struct("batch", "fips")).alias("newest"))
        return newest.select("key", "newest.fips", "newest.batch")

    def unknown(self, df: DataFrame, key: str = "key") -> DataFrame:
        """Rows whose key has no answer yet, hit or miss."""
        return df.join(self.entries().select(F.col("key").alias(key)), key, "left_anti")

    def add(self, answers: DataFrame) -> int:
        """Append what differs from the newest answers, as one batch; the number of new answers."""
        known = self.entries().select("key", F.col("fips").alias("_known"), F.lit(True).alias("_seen"))
        fresh = answers.select("key", "fips").join(known, "key", "left").where(
            F.col("_seen").isNull() | ~F.col("fips").eqNullSafe(F.col("_known"))).select("key", "fips")
        fresh = stage(fresh, "answers")
        n = fresh.count()
        if n:
            files.write_table(fresh, self._path(self.batches() + 1))
        return n
