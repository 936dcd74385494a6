"""Delayed labels: two label streams, resolution as of a date, rows for retraining."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudloom.functions.udfs import fraction_udf

# Salts of the three samples.
HOLDOUT_SALT, INVESTIGATOR_SALT, FLIP_SALT = 0x11111111, 0x22222222, 0x33333333
DAY_US = 86_400_000_000


def delayed_labels(decided: DataFrame, holdout: float = 0.01, sample: float = 0.05, error: float = 0.1, chargeback_days: int = 45, investigator_hours: int = 6) -> DataFrame:
    """decided (txn_id string, us, is_fraud, action) -> (txn_id, value, source, available_us, holdout).

    The outcome is known by chargeback if the payment went through, approved
    or held out; a sample also gets a faster label that may be wrong.
    """
    d = decided.withColumn("holdout", fraction_udf(HOLDOUT_SALT)("txn_id") < holdout).withColumn("_i", fraction_udf(INVESTIGATOR_SALT)("txn_id") < sample).withColumn("_f", fraction_udf(FLIP_SALT)("txn_id") < error)
    name = lambda c: F.when(c, "FRAUD").otherwise("LEGIT")
    row = lambda value, source, delay: F.struct(value.alias("value"), F.lit(source).alias("source"), (F.col("us") + delay).alias("available_us"))
    a = F.when(F.col("holdout") | (F.col("action") == "APPROVE"), row(name(F.col("is_fraud")), "CHARGEBACK", chargeback_days * DAY_US))
    b = F.when(F.col("_i"), row(name(F.col("is_fraud") != F.col("_f")), "INVESTIGATOR", investigator_hours * 3_600_000_000))
    return d.select("txn_id", "holdout", F.explode(F.array_compact(F.array(a, b))).alias("x")).select("txn_id", "x.*", "holdout")


def resolve(labels: DataFrame, as_of: int) -> DataFrame:
    """labels (txn_id, seq, value, source, available_us) known by then -> one a transaction: the first chargeback, else the first in seq order."""
    w = Window.partitionBy("txn_id").orderBy(F.when(F.col("source") == "CHARGEBACK", 0).otherwise(1), "seq")
    return labels.filter(F.col("available_us") <= as_of).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "seq")


def investigator_rows(labels: DataFrame) -> DataFrame:
    """Training rows of weight 1 from analysts' verdicts."""
    return labels.select("subject", (F.col("value") == "FRAUD").cast("int").alias("label"), F.lit(1.0).alias("weight"), F.lit("investigator").alias("origin"))


def reject_inferred_rows(scored: DataFrame) -> DataFrame:
    """scored (subject, p): label at one half, weight by distance from it."""
    return scored.select("subject", (F.col("p") >= 0.5).cast("int").alias("label"), (2 * F.abs(F.col("p") - 0.5)).alias("weight"), F.lit("reject_inference").alias("origin"))


def zipped(subjects: DataFrame, scores: DataFrame) -> DataFrame:
    """subjects (pos, subject) and scores (pos, p) side by side, as (subject, p); a position that only one side has is an error."""
    j = subjects.select("pos", "subject", F.lit(True).alias("_a")).join(scores.select("pos", "p", F.lit(True).alias("_b")), "pos", "full")
    whole = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.select(F.when(whole, F.col("subject")).otherwise(F.raise_error(F.concat(F.lit("one side has no position "), F.col("pos").cast("string"))).cast(subjects.schema["subject"].dataType)).alias("subject"), "p")


def retrain_rows(labels: DataFrame, scored: DataFrame) -> DataFrame:
    return investigator_rows(labels).unionByName(reject_inferred_rows(scored))
