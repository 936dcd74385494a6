"""Shared pieces of the training-data operators: code shipping and bounded blocks,
with the library's written tables and connected components."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudloom.operators.components import connected_components
from fraudloom.scratch import Scratch, shared_dir

__all__ = ["Scratch", "connected_components", "in_blocks", "prepare", "shared_dir", "table", "tasks", "unused"]

WORD = r"[^\x20\x09-\x0D]+"
ARROW_ROWS = 1000
ARROW_BYTES = 32 << 20


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that rows of very long texts don't meet in one batch; ships the package once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_fraudloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, dirs, names in os.walk(root):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="fraudloom-code-"), "fraudloom_code.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(path)
    sc._fraudloom_shipped = True


def in_blocks(scratch: Scratch, rows: DataFrame, key: str, spread: str, block: int) -> DataFrame:
    """Rows of keys with two rows or more, as (bi, bj, side, ...) of block pairs.

    A key with n rows is cut into ceil(n / block) blocks by the hash of
    `spread`; each pair of blocks (bi <= bj) is a unit of work of at most about
    2 * block rows, so any hot key is split and still compared in full. The
    counts are a written table: the join back is between plain sides, so the
    planner may broadcast it while it is small and AQE may split a hot key.
    """
    n = scratch.table(rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1"), "counts")
    nb = F.expr(f"cast(ceil(_n / {float(block)}D) as int)")
    own = F.pmod(F.xxhash64(spread), F.col("_nb")).cast("int")
    return (rows.join(n, key).withColumn("_nb", nb).withColumn("_own", own)
            .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
            .withColumn("bi", F.least("_own", "_o")).withColumn("bj", F.greatest("_own", "_o"))
            .withColumn("side", (F.col("_own") == F.col("bj")).cast("int")).drop("_n", "_nb", "_own", "_o"))


def unused(columns: list[str], name: str) -> str:
    """The name, or one made from it, that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
