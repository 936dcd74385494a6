"""A table of latest values in hash buckets: runs of growing size, merged level by level, read by bucket."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of a level that become one of the next; buckets of a run.
FANOUT, BUCKETS = 4, 16
_RUN = re.compile(r"run=(\d+)-(\d+)$")


def bucket_of(key: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _best(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), order).alias("r")).select("r.*")


class Runs:
    """The folders of one store: run=a-b holds, by bucket, the latest rows of batches a to b."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def all(self) -> list[tuple[int, int]]:
        if not self.fs.exists(self.root):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.root)]
        return sorted((int(m[1]), int(m[2])) for x in names if (m := _RUN.match(x)) and self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}/_SUCCESS")))

    def live(self, below: int | None = None, within: tuple[int, int] | None = None) -> list[tuple[int, int]]:
        """Runs that together hold every batch (before `below`, or what the run `within` is made of) once: those that no wider one covers."""
        done = [r for r in self.all() if below is None or r[1] < below]
        if within is not None:
            done = [r for r in done if within[0] <= r[0] and r[1] <= within[1] and r != within]
        return [(a, b) for a, b in done if not any(c <= a and b <= d and (c, d) != (a, b) for c, d in done)]

    def folder(self, run: tuple[int, int]) -> str:
        return f"{self.path}/run={run[0]:012d}-{run[1]:012d}"

    def read(self, runs: list[tuple[int, int]]) -> DataFrame | None:
        if not runs:
            return None
        parts = [self.spark.read.parquet(self.folder(r)) for r in runs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def write(self, rows: DataFrame, run: tuple[int, int], key: str, buckets: int) -> None:
        d = rows.withColumn("bucket", bucket_of(key, buckets))
        d.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.folder(run))

    def drop(self, run: tuple[int, int]) -> None:
        self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.folder(run)), True)


def upsert_latest(path: str, key: str, order: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: the latest row of each key by `order`, read with latest().

    A batch writes its own rows only. Every FANOUT batches they become one
    run, every FANOUT such runs a wider one, and so on: a row is written again
    as often as the level rises, the logarithm of the batches, and nothing
    else is ever rewritten. Repeating a batch after a failure gives the same
    folders. What a merge has replaced goes when its level merges next, so
    readers that began before a merge can end. One writer at a time; the
    number of buckets stays what it was at first.
    """
    def write(batch: DataFrame, n: int) -> None:
        runs = Runs(batch.sparkSession, path)
        runs.write(_best(batch, key, order), (n, n), key, buckets)
        width = FANOUT
        while (n + 1) % width == 0:
            merged = (n - width + 1, n)
            runs.write(_best(runs.read(runs.live(within=merged)).drop("bucket"), key, order), merged, key, buckets)
            for a, b in runs.all():  # replaced by the merge before this one
                if b < merged[0] and b - a + 1 < width and a >= merged[0] - width:
                    runs.drop((a, b))
            width *= FANOUT

    return write


def latest(spark: SparkSession, path: str, key: str, order: str, below: int | None = None, wanted: list[int] | None = None) -> DataFrame | None:
    """The upserted table (as before batch `below`), None before the first batch; with `wanted` only these buckets are opened."""
    runs = Runs(spark, path)
    rows = runs.read(runs.live(below))
    if rows is None:
        return None
    if wanted is not None:
        rows = rows.filter(F.col("bucket").isin(wanted))
    return _best(rows.drop("bucket"), key, order)
