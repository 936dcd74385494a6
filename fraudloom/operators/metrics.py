"""Evaluation of rankings under imbalance, drift, nearest-rank percentiles.

Cumulative counts over all scores come from per-score totals by quantile
ranges of the score, so no task sorts everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudloom.operators.ranges import nearest_ranks, running

def curve(scored: DataFrame) -> DataFrame:
    """scored (y, score) -> a row for each distinct score: tp and fp with scores at least so high, and totals p, n."""
    g = scored.groupBy("score").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    d, total = running(g, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")}, "curve")
    return d.select("score", "tp", "fp", F.lit(total["tp"]).cast("long").alias("p"), F.lit(total["fp"]).cast("long").alias("n"), "pos")


def average_precision(scored: DataFrame) -> DataFrame:
    """One row: sum over scores of the step in recall times precision; equal scores step together."""
    c = curve(scored)
    return c.agg(F.sum(F.col("pos") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("pr_auc"))


def recall_at_fpr(scored: DataFrame, target: float = 0.01) -> DataFrame:
    """One row: the best recall whose false-positive rate is within the target, its threshold and alerts per fraud caught.

    If no score qualifies, recall is 0 and the threshold infinite.
    """
    c = curve(scored).filter(F.col("fp") / F.col("n") <= target)
    best = c.agg(F.max(F.struct((F.col("tp") / F.col("p")).alias("recall"), F.col("score").alias("threshold"), "tp", "fp")).alias("b"))
    return best.select(F.coalesce("b.recall", F.lit(0.0)).alias("recall"), F.coalesce("b.threshold", F.lit(float("inf"))).alias("threshold"),
                       F.coalesce((F.col("b.tp") + F.col("b.fp")) / F.greatest("b.tp", F.lit(1)), F.lit(0.0)).alias("alert_to_fraud"))


def precision_at(scored: DataFrame, n: int, tie: str) -> DataFrame:
    """Mean label of the n highest scores, ties by `tie`."""
    return scored.orderBy(F.desc("score"), tie).limit(n).agg(F.avg("y").alias("precision"))


def psi(reference: DataFrame, current: DataFrame, value: str = "value", bins: int = 10, eps: float = 1e-6, alert: float = 0.25) -> DataFrame:
    """One row (psi, drift): equal-width bins over the joint range, shares clipped at eps; 0 if a side is empty or there is one value."""
    both = reference.select(F.col(value).alias("v"), F.lit(0).alias("side")).unionByName(current.select(F.col(value).alias("v"), F.lit(1).alias("side"))).filter("v is not null")
    span = both.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = both.crossJoin(F.broadcast(span)).select("side", F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(bins - 1)).alias("bin"))  # one row
    c = b.groupBy("bin").agg(F.count_if(F.col("side") == 0).alias("c0"), F.count_if(F.col("side") == 1).alias("c1"))
    grid = reference.sparkSession.range(bins).select(F.col("id").alias("bin")).join(c, "bin", "left").crossJoin(F.broadcast(span))
    p0, p1 = (F.greatest(F.try_divide(F.coalesce(f"c{k}", F.lit(0)), F.col(f"n{k}")), F.lit(eps)) for k in (0, 1))
    one = grid.agg(F.sum((p1 - p0) * F.ln(p1 / p0)).alias("s"), F.first("n0").alias("n0"), F.first("n1").alias("n1"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    empty = (F.col("n0") == 0) | (F.col("n1") == 0) | (F.col("hi") - F.col("lo") < 2.220446049250313e-16) | F.col("lo").isNull()
    return one.select(F.when(empty, 0.0).otherwise(F.col("s")).alias("psi")).withColumn("drift", F.col("psi") > alert)


def nearest_rank(df: DataFrame, value: str, *shares: float) -> DataFrame:
    """Nearest-rank percentiles as one row, p50, p99, ..."""
    names = [f"p{s * 100:g}".replace(".", "_") for s in shares]
    kind = df.schema[value].dataType
    return df.sparkSession.createDataFrame([tuple(nearest_ranks(df, value, list(shares)))], T.StructType([T.StructField(n, kind) for n in names]))
