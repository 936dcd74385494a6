"""Push-payment rules: authorised push-payment fraud, coercion, recipient freeze."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PEERS = 5
DEAD_TIME_SECS = 20.0
FREEZE_SCORE = 0.5


def app_fraud(p: DataFrame, peers: int = PEERS) -> DataFrame:
    """Adds new_payee, prior_max, prior_payers and app_fraud to payments (seq, payer, payee, amount_minor, us).

    A payment fires if its payer never paid the payee, the amount is above all
    the payer's earlier ones and fewer than `peers` others paid the payee before.
    """
    pair = Window.partitionBy("payer", "payee").orderBy("us", "seq")
    payer = Window.partitionBy("payer").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    payee = Window.partitionBy("payee").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    d = p.withColumn("new_payee", F.row_number().over(pair) == 1)
    d = d.withColumn("prior_max", F.coalesce(F.max("amount_minor").over(payer), F.lit(0)))
    d = d.withColumn("prior_payers", F.coalesce(F.sum(F.col("new_payee").cast("long")).over(payee), F.lit(0)))
    fires = F.col("new_payee") & (F.col("amount_minor") > F.col("prior_max")) & (F.col("prior_payers") < peers)
    return d.withColumn("app_fraud", fires).withColumn("action", F.when(fires, "STEP_UP")).withColumn("confirm_payee", fires)


def coercion(signals: DataFrame, dead_time: float = DEAD_TIME_SECS) -> DataFrame:
    """signals (inbound_call, segmented_typing, dead_time_secs): a call with segmented typing or a long pause holds the payment."""
    fires = F.col("inbound_call") & (F.col("segmented_typing") | (F.col("dead_time_secs") >= dead_time))
    return signals.withColumn("coercion", fires).withColumn("action", F.when(fires, "HOLD")).withColumn("show_warning", fires)


def recipient_freeze(scores: DataFrame, least: float = FREEZE_SCORE) -> DataFrame:
    """scores (mule_score): a likely mule is declined, frozen and flagged for a report."""
    fires = F.col("mule_score") >= least
    return scores.withColumn("freeze", fires).withColumn("disposition", F.when(fires, "HARD_DECLINE")).withColumn("file_sar", fires)
