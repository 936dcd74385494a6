"""Written tables in the folder that driver and executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset (tests on a local master) a folder of our own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local_dirs.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="fraudloom-"))


#: Every folder opened by this process, in order; remove() those whose results are written elsewhere.
OPENED: list[Scratch] = []


class Scratch:
    """A folder of written tables under the shared one.

    An operator's result may read them lazily, so it can't remove them
    itself: its caller does, after writing the result, or the end of the
    process.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/fraudloom-{name}-{uuid.uuid4().hex}"
        self.n = 0
        OPENED.append(self)

    def path(self, tag: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n}-{tag}"

    def table(self, df: DataFrame, tag: str, **options) -> DataFrame:
        p = self.path(tag)
        df.write.options(**options).parquet(p)
        out = self.spark.read.schema(df.schema).parquet(p)
        out._scratch_path = p
        return out

    def _delete(self, path: str) -> None:
        hp = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hp.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hp, True)

    def drop(self, df: DataFrame) -> None:
        """Deletes one table, if df is one of ours."""
        if p := getattr(df, "_scratch_path", None):
            self._delete(p)

    def remove(self) -> None:
        """Deletes the folder."""
        self._delete(self.base)
        if self in OPENED:
            OPENED.remove(self)


def remove_all() -> None:
    """Deletes every folder still open whose session is running."""
    for s in list(OPENED):
        if s.spark.sparkContext._jsc is None:  # stopped
            OPENED.remove(s)
        else:
            s.remove()


@atexit.register
def _at_exit() -> None:
    with suppress(Exception):  # the JVM may be gone; then nobody reads the folders either
        remove_all()
