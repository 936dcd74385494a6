"""Synthetic sources: the seeded transaction generator, scenarios with running metrics, training data, telemetry model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fraudloom.config import Rules
from fraudloom.functions import scalars as S
from fraudloom.functions.udfs import below_udf, splitmix_draw
from fraudloom.operators import decide as D
from fraudloom.operators import rules as R
from fraudloom.operators.windows import FEATURES

SCENARIOS = ("legitimate", "card_testing", "high_amount", "blocklisted_bin")
BLOCKED_BIN = "400099"
SIM_START_MS = 1_780_000_000_000
METRICS_EVERY = 10
STREAM_DEFAULT, STREAM_CAP = 50, 1_000


def population_sizes(size: int) -> dict[str, int]:
    cards = max(size, 1)
    return {"cards": cards, "accounts": cards, "devices": max(cards // 3, 1), "merchants": max(cards // 20, 1), "ips": max(cards // 2, 1)}


def population(spark: SparkSession, size: int, seed: int) -> dict[str, DataFrame]:
    """Cards and addresses take the generator's first draws, cards first; the others are numbered."""
    n = population_sizes(size)
    below = below_udf(seed)
    cards = spark.range(n["cards"]).select("id", F.concat(F.lit("4"), F.lpad(below("id", F.lit(10**15)).cast("string"), 15, "0")).alias("pan"))
    octet = lambda v, k: F.shiftright(v, 8 * k).bitwiseAND(F.lit(255).cast("long"))
    v = below(F.col("id") + n["cards"], F.lit(2**32))
    ips = spark.range(n["ips"]).select("id", v.alias("v")).select("id", F.concat_ws(".", *[octet(F.col("v"), k) for k in (3, 2, 1, 0)]).alias("ip"))
    name = lambda k, p: spark.range(n[k]).select("id", F.concat(F.lit(p), F.col("id")).alias(k[:-1]))
    return {"cards": cards, "ips": ips, "accounts": name("accounts", "acct-"), "devices": name("devices", "dev-"), "merchants": name("merchants", "mrc-")}


def transactions(spark: SparkSession, count: int, size: int = 100, seed: int = 1, rate: int = 50, start_us: int = SIM_START_MS * 1000) -> DataFrame:
    """count legitimate transactions: row i uses five draws after those of the population, in the order amount, card, merchant, device, address.

    The generator is counter-based, so every row computes its own draws and
    the table is made in parallel; picks are computed, not joined.
    """
    if rate <= 0:
        raise ValueError("rate must be positive")
    n = population_sizes(size)
    below, first = below_udf(seed), n["cards"] + n["ips"]
    k = lambda j: F.col("id") * 5 + first + j
    d = spark.range(count).select("id", (below(k(0), F.lit(49_900)) + 100).alias("amount_minor"), below(k(1), F.lit(n["cards"])).alias("_c"), below(k(2), F.lit(n["merchants"])).alias("_m"), below(k(3), F.lit(n["devices"])).alias("_d"), below(k(4), F.lit(n["ips"])).alias("_i"))
    pan = F.concat(F.lit("4"), F.lpad(below("_c", F.lit(10**15)).cast("string"), 15, "0"))
    v = below(F.col("_i") + n["cards"], F.lit(2**32))
    d = d.withColumn("_pan", pan).withColumn("_v", v)
    octet = lambda j: F.shiftright("_v", 8 * j).bitwiseAND(F.lit(255).cast("long"))
    step_ns = 1_000_000_000 // rate
    return d.select(F.concat(F.lit("txn-"), F.col("id")).alias("txn_id"), (F.lit(start_us) + F.floor(F.col("id") * step_ns / 1000)).cast("long").alias("us"), "amount_minor", F.lit("USD").alias("currency"),
                    S.pan_bin(F.col("_pan")).alias("bin"), S.pan_token(F.col("_pan")).alias("card_token"), F.concat(F.lit("mrc-"), F.col("_m")).alias("merchant"), F.concat(F.lit("dev-"), F.col("_d")).alias("device"), F.concat_ws(".", *[octet(j) for j in (3, 2, 1, 0)]).alias("ip"))


def scenario_requests(spark: SparkSession, scenario: str, count: int = STREAM_DEFAULT) -> DataFrame:
    """Shaped requests; an unknown scenario is the legitimate one."""
    i = F.col("id")
    pad = lambda c: F.lpad(c.cast("string"), 10, "0")
    shape: dict[str, tuple[Column, Column, Column, Column]] = {
        "legitimate": (F.concat(F.lit("4"), F.lpad((10_000 + i % 50).cast("string"), 5, "0")), i % 100_000, 1_000 + i % 40_000, F.concat(F.lit("dev-"), i % 200)),
        "card_testing": (F.lit("400123"), i, F.lit(100), F.lit("dev-attacker")),
        "high_amount": (F.lit("400500"), F.lit(7), F.when(i < 5, 5_000).otherwise(900_000), F.lit("dev-victim")),
        "blocklisted_bin": (F.lit(BLOCKED_BIN), i % 100_000, F.lit(4_999), F.concat(F.lit("dev-"), i)),
    }
    bin_, tail, amount, device = shape.get(scenario, shape["legitimate"])
    null = lambda t: F.lit(None).cast(t)
    return spark.range(count).select(
        F.concat(F.lit("sim-"), i).alias("idempotency_key"), F.concat(F.lit("sim-txn-"), i).alias("transaction_id"), amount.cast("long").alias("amount_minor_units"), F.lit("USD").alias("currency"), F.lit("CARD").alias("vertical"),
        F.lit("CARD_NOT_PRESENT").alias("channel"), F.concat(bin_, pad(tail)).alias("pan"), F.concat(F.lit("mrc-"), i % 50).alias("merchant"), device.alias("device"), (F.lit(SIM_START_MS) + i * 1_000).alias("occurred_at_unix_ms"),
        F.lit(0).alias("mcc"), null("boolean").alias("avs_match"), null("boolean").alias("cvv_match"), F.lit("").alias("ip"), F.lit("").alias("geo_country"), F.lit(0.0).alias("geo_lat"), F.lit(0.0).alias("geo_lon"), i.alias("seq"))


def run_scenario(spark: SparkSession, scenario: str, count: int = STREAM_DEFAULT) -> DataFrame:
    """Decisions and running metrics interleaved: type, seq and the fields of either; metrics after every tenth decision and at the end.

    One scenario is at most STREAM_CAP rows, as the stream it serves.
    """
    from fraudloom.sources.requests import normalise

    count = min(count, STREAM_CAP)
    req = scenario_requests(spark, scenario, count)
    txn = normalise(req).join(req.select(F.col("transaction_id").alias("txn_id"), "seq"), "txn_id").withColumn("declined", F.lit(False))
    d = D.decide_rules_only(R.evaluate(txn, Rules(version="sim", deny_bins=(BLOCKED_BIN,)), "seq")).select("seq", "txn_id", "action", "score", "reason_codes")
    w = Window.partitionBy(F.lit(0)).orderBy("seq")  # STREAM_CAP rows at most
    run = lambda c: F.sum(c.cast("long")).over(w)
    m = d.withColumn("processed", F.row_number().over(w).cast("long")).withColumn("approved", run(F.col("action") == "APPROVE")).withColumn("declined", run(F.col("action") == "DECLINE")).withColumn("alerts", run(F.size("reason_codes") > 0))
    m = m.withColumn("decline_rate", F.col("declined") / F.col("processed"))
    names = ["processed", "approved", "declined", "alerts", "decline_rate"]
    blank = {"txn_id": "string", "action": "string", "score": "double", "reason_codes": "array<string>"}
    decisions = d.select(F.lit("decision").alias("type"), "seq", F.lit(0).alias("ord"), *blank, *[F.lit(None).cast("double" if n == "decline_rate" else "long").alias(n) for n in names])
    null = [F.lit(None).cast(t).alias(c) for c, t in blank.items()]
    tenth = m.filter(F.col("processed") % METRICS_EVERY == 0).select(F.lit("metrics").alias("type"), "seq", F.lit(1).alias("ord"), *null, *names)
    if count == 0:
        last = spark.range(1).select(F.lit("metrics").alias("type"), F.lit(0).cast("long").alias("seq"), F.lit(2).alias("ord"), *null, *[F.lit(0).cast("double" if n == "decline_rate" else "long").alias(n) for n in names])
    else:
        last = m.filter(F.col("processed") == count).select(F.lit("metrics").alias("type"), "seq", F.lit(2).alias("ord"), *null, *names)
    return decisions.unionByName(tenth).unionByName(last).orderBy("seq", "ord")


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, s) for k, s in enumerate(SCENARIOS)], "ord int, id string")


def training_data(spark: SparkSession, rows: int = 20_000, fraud_rate: float = 0.01, seed: int = 7) -> DataFrame:
    """Labelled rows (id, the eight features, y) of the two populations below; the first ids are legitimate, the last ones fraud.

    Each id draws its own row from a generator seeded by (seed, id), so the
    table is made in parallel and looks the same however it is cut.
    """
    n1 = max(1, int(rows * fraud_rate))
    names = [f"f_{n}" for n in FEATURES]

    def draw_rows(batches):
        for b in batches:
            out = []
            for k in b["id"].tolist():
                rng, y = np.random.default_rng((seed, k)), int(k >= rows - n1)
                out.append([k, *(max(0.0, d(rng)) if clip else d(rng) for d, clip in POPULATIONS[y]), y])
            yield pd.DataFrame(out, columns=["id", *names, "y"])

    return spark.range(rows).mapInPandas(draw_rows, "id long, " + ", ".join(f"{n} double" for n in names) + ", y int")


# Distribution of each feature (cut off at 0 where marked) among legitimate rows and among fraud.
POPULATIONS = [
    [(lambda g: g.poisson(1.0), False), (lambda g: g.poisson(3.0), False), (lambda g: g.poisson(10.0), False), (lambda g: g.normal(1.0, 0.3), True),
     (lambda g: g.normal(0.0, 1.0), False), (lambda g: g.poisson(1.0), False), (lambda g: g.beta(1.0, 20.0), False), (lambda g: g.binomial(1, 0.03), False)],
    [(lambda g: g.poisson(5.0), False), (lambda g: g.poisson(15.0), False), (lambda g: g.poisson(40.0), False), (lambda g: g.normal(5.0, 2.0), True),
     (lambda g: g.normal(3.0, 1.5), False), (lambda g: g.poisson(4.0), False), (lambda g: g.beta(4.0, 6.0), False), (lambda g: g.binomial(1, 0.30), False)],
]


# Fixed values of the dashboard's queueing model.
CAPACITY = {"baseline": 23_000, "fraud-surge": 20_500, "card-testing": 21_500, "degrade": 14_000}
SHARES = {"baseline": (0.018, 0.05), "fraud-surge": (0.14, 0.17), "card-testing": (0.22, 0.08), "degrade": (0.03, 0.07)}
SLA_P99, P99_MAX = 20.0, 30.0
STAGES = ["rules", "features", "ML", "graph", "compliance"]
BOTTLENECK = {"baseline": "ML", "fraud-surge": "ML", "card-testing": "graph", "degrade": "compliance"}
QUEUE_FROM, QUEUE_SHARE, STAGE_LOSS, IDLE_P99 = 0.72, 0.5, 0.0025, 3.0


def p99_for(rho: Column) -> Column:
    r = F.least(F.lit(0.97), F.greatest(F.lit(0.0), rho))
    return 3 + 2.4 * r * r / (1 - r)


def rho_for(p99: Column) -> Column:
    c = (p99 - 3) / 2.4
    return (-c + F.sqrt(c * c + 4 * c)) / 2


def _pick(scenario: Column, table: dict[str, float | str], default: float | str | None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(scenario == k, F.lit(v)).otherwise(out)
    return out


def telemetry(controls: DataFrame) -> DataFrame:
    """controls (scenario, target_tps, fault, running if there) -> offered, admitted, shed, rho, p50, p95, p99, degrade, the action mix and the stages.

    A control that isn't running gives zeros, the idle p99 and empty queues.
    """
    cap = _pick(F.col("scenario"), CAPACITY, 23_000).cast("double") * F.when(F.col("fault"), 0.6).otherwise(1.0)
    d = controls.withColumn("capacity", cap).withColumn("offered", F.greatest(F.lit(0), F.round("target_tps")).cast("long"))
    most = F.col("capacity") * rho_for(F.lit(SLA_P99 - 1))
    d = d.withColumn("degrade", F.col("offered") > most).withColumn("admitted", F.when(F.col("degrade"), F.round(most).cast("long")).otherwise(F.col("offered")))
    d = d.withColumn("shed", F.col("offered") - F.col("admitted")).withColumn("rho", F.col("admitted") / F.col("capacity"))
    d = d.withColumn("p99", F.least(F.lit(P99_MAX), F.round(p99_for(F.col("rho")), 1))).withColumn("p95", F.round(F.col("p99") * 0.72, 1)).withColumn("p50", F.round(F.col("p99") * 0.41, 1))
    decline, review = _pick(F.col("scenario"), {k: v[0] for k, v in SHARES.items()}, 0.018), _pick(F.col("scenario"), {k: v[1] for k, v in SHARES.items()}, 0.05)
    d = d.withColumn("decline_share", decline).withColumn("review_share", review).withColumn("approve_share", F.round(1 - decline - review, 3)).withColumn("wall_tps", F.round(F.col("capacity") * rho_for(F.lit(SLA_P99))).cast("long"))
    slow = _pick(F.col("scenario"), BOTTLENECK, None)
    waiting = F.when(F.col("rho") > QUEUE_FROM, F.round((F.col("rho") - QUEUE_FROM) * F.col("capacity") * QUEUE_SHARE)).otherwise(0).cast("long")
    on = F.coalesce(F.col("running"), F.lit(True)) if "running" in controls.columns else F.lit(True)
    stages = [F.struct(F.lit(s).alias("stage"), F.when(on, F.round(F.col("admitted") * (1 - STAGE_LOSS * k))).otherwise(0).cast("long").alias("tps"),
                       F.when(on & slow.eqNullSafe(F.lit(s)), waiting).otherwise(0).cast("long").alias("queue"), slow.eqNullSafe(F.lit(s)).alias("bottleneck")) for k, s in enumerate(STAGES)]
    d = d.withColumn("stages", F.array(*stages))
    for c in ("offered", "admitted", "shed", "rho", "p50", "p95", "decline_share", "review_share", "approve_share"):
        d = d.withColumn(c, F.when(on, F.col(c)).otherwise(F.lit(0).cast(d.schema[c].dataType)))
    return d.withColumn("p99", F.when(on, F.col("p99")).otherwise(IDLE_P99)).withColumn("degrade", on & F.col("degrade"))


def seed_trail(spark: SparkSession, scenario: str, target_tps: float, fault: bool = False, n: int = 18) -> DataFrame:
    ramp = spark.range(1, n + 1).select("id", F.lit(scenario).alias("scenario"), (F.lit(target_tps) * (0.3 + 0.7 * F.col("id") / n)).alias("target_tps"), F.lit(fault).alias("fault"))
    return telemetry(ramp).select("id", F.col("admitted").alias("tps"), "p99")


def draw(seed: int, k: int) -> int:
    """One draw, for checks against published vectors."""
    return int(splitmix_draw(seed, np.array([k]))[0])
