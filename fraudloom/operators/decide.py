"""Decisions: fusion of hits and model score, reason codes, idempotency, degradation, champion and challenger."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudloom.config import Costs
from fraudloom.functions import scalars as S
from fraudloom.operators import rules as R

DEGRADED = "DEGRADED_RULES_ONLY"
SOFT_WEIGHT = 0.1
HARD_SCORE = 0.99
TOP_K = 3
# Feature position, reason code and alert threshold.
MODEL_REASONS = [
    ("MODEL_HIGH_VELOCITY_5M", 3.0),
    ("MODEL_HIGH_VELOCITY_1H", 10.0),
    ("MODEL_HIGH_VELOCITY_24H", 25.0),
    ("MODEL_AMOUNT_RATIO", 3.0),
    ("MODEL_AMOUNT_ZSCORE", 2.0),
    ("MODEL_DEVICE_SPREAD", 3.0),
    ("MODEL_DECLINE_RATE", 0.3),
    ("MODEL_HIGH_RISK_MCC", 0.5),
]


def fuse_rules(df: DataFrame) -> DataFrame:
    """Adds band, action and score from hits alone."""
    hard, soft = R.any_hard(F.col("hits")), R.soft_count(F.col("hits"))
    pick = lambda h, none, some, many: F.when(hard, h).when(soft == 0, none).when(soft <= 2, some).otherwise(many)
    return (df.withColumn("band", pick(F.lit("VERY_HIGH"), F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")))
            .withColumn("action", pick(F.lit("DECLINE"), F.lit("APPROVE"), F.lit("STEP_UP"), F.lit("REVIEW")))
            .withColumn("score", pick(F.lit(HARD_SCORE), F.lit(0.02), F.lit(0.5), F.lit(0.8))))


def expected_costs(p: Column, costs: Costs = Costs()) -> Column:
    """Structs of (cost, order, action); the smallest is the choice, ties to the earlier action."""
    return F.array(*[F.struct((p * getattr(costs, f.name)[0] + (1 - p) * getattr(costs, f.name)[1]).alias("cost"), F.lit(k).alias("ord"), F.lit(f.name.upper()).alias("action")) for k, f in enumerate(fields(Costs))])


def fuse_expected_cost(df: DataFrame, model_score: str = "model_score", costs: Costs = Costs()) -> DataFrame:
    """Adds band, action and score: a score that isn't finite counts as 1; a hard hit declines; else the cheapest action."""
    m = F.col(model_score)
    m = F.when(m.isNull() | F.isnan(m) | (F.abs(m) == float("inf")), F.lit(1.0)).otherwise(m)
    hard = R.any_hard(F.col("hits"))
    d = df.withColumn("_p", F.when(hard, F.greatest(m, F.lit(HARD_SCORE))).otherwise(S.clamp01(m + SOFT_WEIGHT * R.soft_count(F.col("hits")))))
    d = d.withColumn("action", F.when(hard, F.lit("DECLINE")).otherwise(F.array_min(expected_costs(F.col("_p"), costs))["action"]))
    return d.withColumn("band", F.when(hard, F.lit("VERY_HIGH")).otherwise(S.risk_band(F.col("_p")))).withColumn("score", F.col("_p")).drop("_p")


def model_reasons(vector: Column, top_k: int = TOP_K) -> Column:
    """Codes of features at or over their threshold, strongest first, ties in feature order, top_k at most."""
    items = F.array(*[F.struct((-(F.element_at(vector, k + 1).cast("double") / t)).alias("weak"), F.lit(k).alias("ord"), F.lit(code).alias("code")) for k, (code, t) in enumerate(MODEL_REASONS)])
    over = F.array_sort(F.filter(items, lambda x: x["weak"] <= -1.0))
    return F.transform(F.slice(over, 1, top_k), lambda x: x["code"])


Scorer = Callable[[DataFrame], DataFrame]


def surrogate_scorer(df: DataFrame) -> DataFrame:
    """A fixed logistic over the feature columns: stands in for a trained model where results must be reproducible."""
    weights = dict(velocity_5m=0.35, velocity_1h=0.1, velocity_24h=0.04, amount_ratio=0.15, amount_zscore=0.25, device_spread=0.2, decline_rate=1.5, high_risk_mcc=1.1)
    z = F.lit(-4.0)
    for n, w in weights.items():
        z = z + F.lit(w) * F.col(f"f_{n}").cast("double")
    return df.withColumn("model_score", 1 / (1 + F.exp(-z)))


def decide_rules_only(evaluated: DataFrame) -> DataFrame:
    d = fuse_rules(evaluated)
    return d.withColumn("reason_codes", R.reason_codes(F.col("hits"))).withColumn("model_version", F.lit("none"))


def decide(evaluated: DataFrame, scorer: Scorer = surrogate_scorer, costs: Costs = Costs(), model_version: str = "surrogate-1", status: str | None = None) -> DataFrame:
    """Full decisions of rows with hits and the feature vector.

    status names a column: OK or MISS (empty aggregates) let the model speak;
    TIMED_OUT or ERROR fall back to the rules and add the marker last.
    """
    d = scorer(evaluated)
    model = fuse_expected_cost(d, costs=costs).select(*d.columns, F.col("band").alias("_mb"), F.col("action").alias("_ma"), F.col("score").alias("_ms"))
    d = fuse_rules(model)
    bad = F.col(status).isin("TIMED_OUT", "ERROR") if status else F.lit(False)
    codes = R.reason_codes(F.col("hits"))
    out = d.withColumn("degraded", bad).withColumn("reason_codes", F.when(bad, F.concat(codes, F.array(F.lit(DEGRADED)))).otherwise(F.concat(codes, model_reasons(F.col("vector")))))
    for name, alt in (("band", "_mb"), ("action", "_ma"), ("score", "_ms")):
        out = out.withColumn(name, F.when(F.col("degraded"), F.col(name)).otherwise(F.col(alt)))
    return out.withColumn("model_version", F.when(F.col("degraded"), "none").otherwise(model_version)).drop("_mb", "_ma", "_ms")


def approve_all(evaluated: DataFrame) -> DataFrame:
    """The placeholder decider: every row is approved, whatever hit."""
    return evaluated.withColumn("action", F.lit("APPROVE")).withColumn("score", F.lit(0.0)).withColumn("band", F.lit("LOW")).withColumn("reason_codes", F.array().cast("array<string>")).withColumn("rule_version", F.lit("rules-v0")).withColumn("model_version", F.lit("none"))


def with_packs(evaluated: DataFrame, *packs: Column) -> DataFrame:
    """Appends the hits of vertical packs (hit structs or null, in order) to the rules' own, before the fusion."""
    return evaluated.withColumn("hits", F.concat("hits", F.array_compact(F.array(*[p.cast(R.HIT) for p in packs]))))


def idempotent(decisions: DataFrame, key: str, arrival: str, verdict: list[str]) -> DataFrame:
    """Every retry of a key gets the verdict of its first arrival; rows with an empty or null key are rejected."""
    w = Window.partitionBy(key).orderBy(arrival)
    d = decisions.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    d = d.withColumn("replayed", F.row_number().over(w) > 1)
    for v in verdict:
        d = d.withColumn(v, F.first(v).over(w))
    return d


def champion_challenger(df: DataFrame, champion: str, challenger: str | None = None) -> DataFrame:
    """The champion's score decides, a null (failed inference) counts as 1; the challenger's is only kept."""
    d = df.withColumn("model_score", F.coalesce(champion, F.lit(1.0)))
    return d.withColumn("shadow_score", F.col(challenger) if challenger else F.lit(None).cast("double"))


def decision_mix(decisions: DataFrame, *by: str) -> DataFrame:
    """Counts and mean scores over the cube of the columns."""
    return decisions.cube(*by).agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("mean_score"))


def audit_records(decisions: DataFrame) -> DataFrame:
    """The twelve audit fields and their JSON payload, a row each."""
    r = decisions.select(
        F.col("txn_id").cast("string").alias("transaction_id"), F.floor(F.col("us") / 1000).alias("decided_at_unix_ms"), F.col("amount_minor").alias("amount_minor_units"), "currency", F.lit("CARD").alias("vertical"),
        F.transform("hits", lambda h: h["rule_id"]).alias("fired_rules"), "action", "band", "score", "reason_codes", "rule_version", "model_version")
    return r.withColumn("payload", F.to_json(F.struct(*r.columns)))


def reproduce(audit: DataFrame, *keep: str) -> DataFrame:
    """The verdict out of the stored payload, beside the columns `keep` of the record."""
    p = F.from_json("payload", "action string, band string, score double, reason_codes array<string>")
    return audit.select("transaction_id", p.alias("p"), *keep).select("transaction_id", "p.*", *keep)
