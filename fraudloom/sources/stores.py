"""Stores: append-only tables with unique keys (audit, labels) and latest-value tables (entity and graph features)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudloom.streaming.latest import BUCKETS, bucket_of, latest, upsert_latest


class DuplicateKey(ValueError):
    pass


class AppendStore:
    """Rows are only ever added; a key that is there already, or twice in what is added, is refused as a whole. One writer at a time: nothing locks the store between the check and the write."""

    def __init__(self, spark: SparkSession, path: str, key: str | None = None):
        self.spark, self.path, self.key = spark, path, key

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def append(self, rows: DataFrame) -> None:
        if self.key:
            if not rows.groupBy(self.key).count().filter("count > 1").isEmpty():
                raise DuplicateKey(f"{self.key} repeats in the rows")
            if self._exists() and not rows.join(self.read().select(self.key), self.key, "left_semi").isEmpty():
                raise DuplicateKey(f"{self.key} is in the store already")
        rows.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


class LatestStore:
    """put() keeps the newest row of each key; get() looks keys up in their buckets, missing ones give nulls."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path, key, order, buckets

    def put(self, rows: DataFrame, batch: int) -> None:
        upsert_latest(self.path, self.key, self.order, self.buckets)(rows, batch)

    def table(self) -> DataFrame | None:
        return latest(self.spark, self.path, self.key, self.order)

    def get(self, keys: DataFrame) -> DataFrame:
        """`keys` with the stored columns and found; only the buckets that the keys fall into are opened."""
        wanted = [r[0] for r in keys.select(bucket_of(self.key, self.buckets)).distinct().collect()]  # as many as there are buckets at most
        t = latest(self.spark, self.path, self.key, self.order, wanted=wanted)
        if t is None:
            raise LookupError(f"nothing was put into {self.path}")
        return keys.join(t.withColumn("found", F.lit(True)), self.key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


class CountingSink:
    """foreachBatch sink that counts rows; a batch that is repeated after a failure counts once."""

    def __init__(self):
        self.batches: dict[int, int] = {}

    def __call__(self, batch: DataFrame, n: int) -> None:
        self.batches[n] = batch.count()

    @property
    def rows(self) -> int:
        return sum(self.batches.values())
