"""Joins of two streams: rows of either side wait in state for as long as the other side may still bring their partner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudloom.operators.crypto import POISON_SECS


def interval_semi(left: DataFrame, right: DataFrame, keys: list[str], secs: int, late_secs: int, also: Column | None = None, ts: str = "us") -> DataFrame:
    """Rows of `left` that have a row of `right` with equal keys, at most `secs` before them (or at the same moment).

    left and right are streams with `ts` in microseconds; `also` may speak of
    l.<column> and r.<column>. Both sides' watermarks follow their own newest
    row by `late_secs`; a row of `right` stays in state for `secs` beyond, one
    of `left` only until it matches or the watermark is past it. Whichever side
    comes first, and however the input is cut, each left row comes out once.
    """
    wide = F.expr(f"interval {secs} seconds")
    side = lambda d, n: d.withColumn(f"_{n}", F.timestamp_micros(ts)).withWatermark(f"_{n}", f"{late_secs} seconds").alias(n)
    on = (F.col("l._l") >= F.col("r._r")) & (F.col("l._l") <= F.col("r._r") + wide)
    for k in keys:
        on &= F.col(f"l.{k}") == F.col(f"r.{k}")
    if also is not None:
        on &= also
    return side(left, "l").join(side(right, "r"), on, "left_semi").drop("_l")


def poisoning(real: DataFrame, candidates: DataFrame, secs: int = POISON_SECS, late_secs: int = 3_600) -> DataFrame:
    """crypto.poisoning() on live transfers: candidates (address, us, ...) that look like an address of a real transfer (address, us) up to `secs` before."""
    def ends(d: DataFrame) -> DataFrame:
        return d.filter(F.length("address") >= 4).withColumn("_h", F.left("address", F.lit(4))).withColumn("_t", F.right("address", F.lit(4)))

    hit = interval_semi(ends(candidates), ends(real.select("address", "us")), ["_h", "_t"], secs, late_secs, F.col("l.address") != F.col("r.address"))
    return hit.drop("_h", "_t").withColumn("reason_code", F.lit("CRYPTO_ADDR_POISON")).withColumn("disposition", F.lit("SOFT"))
