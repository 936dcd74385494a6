"""Named queries over the benchmark tables, each with the same question in DuckDB SQL.

Rule thresholds are those of FIXTURES.md section 3, so that both outcomes occur; *_default queries keep the default settings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudloom.config import Aml, Rules, Sar, Velocity
from fraudloom.functions import scalars as S
from fraudloom.operators import asof as A
from fraudloom.operators import compliance as C
from fraudloom.operators import crypto as X
from fraudloom.operators import decide as D
from fraudloom.operators import graph as G
from fraudloom.operators import labels as L
from fraudloom.operators import metrics as M
from fraudloom.operators import p2p as P
from fraudloom.operators import rings as RG
from fraudloom.operators import rules as R
from fraudloom.operators import windows as W
from fraudloom.plans import sql as Q
from fraudloom.scratch import Scratch
from fraudloom.sources import requests as RQ
from fraudloom.sources import simulator as SIM
from fraudloom.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FIXTURE = Rules(
    version="fixture-1", deny_bins=("400003",), deny_tokens=("400005****0015",), deny_devices=("dev-7",), deny_ips=("10.0.0.13",), deny_merchants=("mrc-9",),
    card_testing=Velocity(86_400, 6, 1_500), bin_attack=Velocity(21_600, 8), decline_retry=Velocity(604_800, 5), max_kmh=1000.0, anomaly_factor=4.0, anomaly_min_samples=5)
#: Rules-only decisions without the travel and decline rules, as in the fixture.
MIX = Rules(**{**FIXTURE.__dict__, "decline_retry": Velocity(1, 1_000_000), "max_kmh": 1e12})
#: What windows by card read.
WINDOWED = ("txn_id", "card_token", "us", "amount_minor", "device", "declined")
AML = Aml(ctr_threshold_minor=30_000_000, structuring_band_minor=5_000_000)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def graph_query(sql: str) -> Callable[[Callable[[SparkSession, DataFrame], DataFrame]], Callable]:
    """Registers f(spark, edges) over every transfer; NAME_all is the same query under the name that it had beside a smaller one."""
    def add(f: Callable[[SparkSession, DataFrame], DataFrame]) -> Callable:
        for name in (f.__name__, f"{f.__name__}_all"):
            QUERIES[name], SQL[name] = lambda spark, sf: f(spark, T.edges(spark, sf)), sql
        return f

    return add


@query(Q.WINDOWS_SIX)
def windows_six(spark, sf):
    d = W.six_windows(T.txn(spark, sf).select(*WINDOWED), "card_token")
    return d.select("txn_id", *[F.col(f"{p}_{h}").cast("string" if p == "sq" else "long").alias(f"{p}_{h}") for h in W.HORIZONS for p in ("cnt", "sum", "sq", "dev", "dec")])


@query(Q.WINDOWS_ENTITY)
def windows_by_entity(spark, sf):
    t = W.fan_out(T.txn(spark, sf)).select("entity", "txn_id", "us", "amount_minor", "device", "declined")
    d = W.six_windows(t, "entity", horizons={"1h": 3_600, "24h": 86_400})
    return d.groupBy("entity").agg(F.sum("cnt_1h").alias("cnt_1h"), F.sum("cnt_24h").alias("cnt_24h"), F.sum("dev_24h").alias("dev_24h"), F.sum("sum_24h").alias("sum_24h"))


@query(Q.POINT_IN_TIME)
def windows_point_in_time(spark, sf):
    t = T.txn(spark, sf)
    asof = t.select("card_token").distinct().withColumn("as_of_us", F.explode(F.array(*[F.lit(x).cast("long") for x in Q.AS_OF])))
    return W.point_in_time(t, asof, "card_token").select("card_token", "as_of_us", *[F.col(f"{p}_{h}").cast("long").alias(f"{p}_{h}") for h in ("24h", "7d", "30d") for p in ("cnt", "sum", "dev", "dec")])


def _featured(spark, sf):
    return W.model_vector(W.deviations(W.lagged(T.txn(spark, sf))))


@query(Q.LAGGED)
def features_lagged(spark, sf):
    d = W.deviations(W.lagged(T.txn(spark, sf)))
    return d.select("txn_id", "cnt_24h", "cnt_30d", "sum_30d", F.round("amount_ratio", 6).alias("amount_ratio"), F.round("amount_zscore", 6).alias("amount_zscore"), "velocity_count")


@query(Q.ASOF_SHIPMENT)
def asof_last_shipment(spark, sf):
    """Each order with what was last shipped to its customer by then."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    o = T.load(spark, sf, "orders").select("o_orderkey", "o_custkey", us("o_orderdate").alias("us"))
    ship = T.load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", us("l_shipdate").alias("us"), T.minor("l_extendedprice").alias("minor")).join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return A.asof_join(o, ship, "o_custkey", "us", "us", ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber", "us", "minor"]).drop("us")


@query(Q.ASOF_DECLINE)
def asof_last_decline(spark, sf):
    """Each transaction with the merchant's last declined one strictly before it, six hours at most."""
    t = T.txn(spark, sf).select("txn_id", "merchant", "us", "amount_minor", "declined")
    d = t.filter("declined").select("merchant", "us", "txn_id", "amount_minor")
    return A.asof_join(t, d, "merchant", "us", "us", ["txn_id"], ["txn_id", "amount_minor"], span_us=A.DAY_US, within_us=6 * 3_600_000_000, strict=True).select("txn_id", "asof_txn_id", "asof_amount_minor")


@query(Q.VECTOR)
def model_vector(spark, sf):
    d = _featured(spark, sf)
    return d.select("txn_id", *[F.round(F.col(f"f_{n}").cast("double"), 3).alias(f"f_{n}") for n in W.FEATURES])


@query(Q.STATELESS)
def rules_stateless(spark, sf):
    hits = F.array_compact(F.array(*R.stateless(FIXTURE)))
    return T.txn(spark, sf).withColumn("hits", hits).select("txn_id", F.array_join(R.reason_codes(F.col("hits")), ",").alias("codes"), R.any_hard(F.col("hits")).alias("hard"), R.soft_count(F.col("hits")).cast("long").alias("soft"))


@query(Q.DENY_JOIN)
def deny_list_semi_join(spark, sf):
    listed = T.load(spark, sf, "supplier").select(F.concat(F.lit("mrc-"), F.col("s_suppkey") % 5).alias("merchant"))
    return R.deny_join(T.txn(spark, sf), listed, "merchant", "denied").groupBy("merchant", "denied").agg(F.count("*").alias("n"))


@query(Q.CARD_TESTING)
def rule_card_testing(spark, sf):
    return R.with_card_testing(T.txn(spark, sf), FIXTURE, "fires").filter("fires").select("txn_id", "device")


@query(Q.CARD_TESTING_DEFAULT)
def rule_card_testing_default(spark, sf):
    return R.with_card_testing(T.txn(spark, sf), Rules(), "fires").groupBy("fires").agg(F.count("*").alias("n"))


@query(Q.BIN_ATTACK)
def rule_bin_attack(spark, sf):
    return R.with_bin_attack(R.with_next_of_card(T.txn(spark, sf), "_next"), FIXTURE, "fires", "_next").filter("fires").select("txn_id", "bin")


@query(Q.DECLINE_RETRY)
def rule_decline_retry(spark, sf):
    return R.with_decline_retry(T.txn(spark, sf), FIXTURE, "fires").filter("fires").select("txn_id", "card_token")


@query(Q.TRAVEL)
def rule_impossible_travel(spark, sf):
    return R.with_speed(T.txn(spark, sf)).filter("kmh > 300").select("txn_id", F.round("kmh", 3).alias("kmh"), (F.col("kmh") > 1000).alias("impossible"))


@query(Q.ANOMALY)
def rule_amount_anomaly(spark, sf):
    d = R.with_history(T.txn(spark, sf)).filter((F.col("prior_n") >= 5) & (F.col("amount_minor") > 4 * F.col("prior_mean")))
    return d.select("txn_id", "prior_n", F.round("prior_mean", 4).alias("prior_mean"), (F.col("amount_minor") > 10 * F.col("prior_mean")).alias("at_default"))


@query(Q.RULES_ONLY)
def decisions_rules_only(spark, sf):
    d = D.decide_rules_only(R.evaluate(T.txn(spark, sf), MIX))
    return d.select("txn_id", "action", "band", "score", F.size("hits").cast("long").alias("n_hits"), F.array_join("reason_codes", ",").alias("codes"))


def _decided(spark, sf, status=None):
    f = _featured(spark, sf)
    cols, d = f.columns, R.evaluate(f, MIX)
    if status is not None:
        d = d.withColumn("feature_status", status)
    return D.decide(d.select(*cols, "hits", "rule_version", *(["feature_status"] if status is not None else [])), status="feature_status" if status is not None else None)


@query(Q.EV)
def decisions_ev(spark, sf):
    return _decided(spark, sf).select("txn_id", "action", "band", F.round("score", 6).alias("score"), F.array_join("reason_codes", ",").alias("codes"))


@query(Q.DEGRADED)
def degraded_decisions(spark, sf):
    status = F.when(F.col("k") % 9 == 0, "TIMED_OUT").when(F.col("k") % 9 == 1, "ERROR").when(F.col("cnt_30d").isNull(), "MISS").otherwise("OK")
    return _decided(spark, sf, status).filter("degraded").select("txn_id", "action", "band", "score", F.array_join("reason_codes", ",").alias("codes"), "model_version")


@query(Q.MIX_CUBE)
def decision_mix_cube(spark, sf):
    d = D.decide_rules_only(R.evaluate(T.txn(spark, sf), MIX))
    return D.decision_mix(d, "action", "merchant").select("action", "merchant", "n", F.round("mean_score", 6).alias("mean_score"))


@query(Q.COSTS)
def expected_cost_actions(spark, sf):
    p = spark.range(1001).select((F.col("id") / 1000).alias("p"))
    best = F.array_min(D.expected_costs(F.col("p")))
    return p.select(F.round("p", 3).alias("p"), best["action"].alias("action"), F.round(best["cost"], 6).alias("cost"), S.risk_band(F.col("p")).alias("band"))


@query(Q.IDEMPOTENT)
def idempotent_replay(spark, sf):
    d = D.decide_rules_only(R.evaluate(T.txn(spark, sf), MIX)).withColumn("key", F.col("txn_id") % 7000)
    return D.idempotent(d, "key", "txn_id", ["action", "score"]).select("txn_id", "key", "replayed", "action", "score")


@query(Q.CHAMPION)
def champion_challenger(spark, sf):
    t = T.scored(spark, sf).withColumn("champ", F.when(F.col("doc_id") % 10 != 3, F.col("score"))).withColumn("chall", 1 - F.col("score"))
    return D.champion_challenger(t, "champ", "chall").select("doc_id", F.round("model_score", 9).alias("model_score"), F.round("shadow_score", 9).alias("shadow_score"))


@query(Q.AUDIT)
def audit_records(spark, sf):
    a = D.audit_records(D.decide_rules_only(R.evaluate(T.txn(spark, sf), MIX)))
    return D.reproduce(a, "decided_at_unix_ms", "amount_minor_units", "fired_rules").select(
        "transaction_id", "action", "band", "score", F.array_join("reason_codes", ",").alias("codes"), "decided_at_unix_ms", "amount_minor_units", F.size("fired_rules").cast("long").alias("n_fired"))


@query(Q.STRUCTURING)
def aml_structuring(spark, sf):
    return C.structuring(T.aml(spark, sf), AML)


@query(Q.FUNNEL)
def aml_funnel(spark, sf):
    return C.funnel(T.aml(spark, sf), AML)


@query(Q.ROUND_TRIP)
def aml_round_trip(spark, sf):
    return C.round_trips(T.aml(spark, sf), AML)


@query(Q.AML_ALERTS)
def aml_alerts(spark, sf):
    return C.aml_alerts(T.aml(spark, sf), AML).select("acct", "typology", "detail")


@query(Q.SCREEN)
def watchlist_screen_jw(spark, sf):
    # The SQL side has no Soundex: alerts whose score reaches the threshold.
    a = C.screen(T.subjects(spark, sf), T.watchlist(spark, sf))
    return a.filter("name_score >= 0.88").select("subject_id", "entry_id", "list", F.round("name_score", 6).alias("name_score"), F.array_join("corroboration", ",").alias("corroboration"))


@query()
def watchlist_screen(spark, sf):
    a = C.screen(T.subjects(spark, sf), T.watchlist(spark, sf))
    return a.select("subject_id", "entry_id", "list", F.round("name_score", 6).alias("name_score"), F.array_join("corroboration", ",").alias("corroboration"))


@query(Q.DELTA)
def watchlist_delta(spark, sf):
    w = T.watchlist(spark, sf)
    a = C.rescreen_delta(T.subjects(spark, sf), w.filter("entry_id % 2 = 0"), w)
    return a.filter("name_score >= 0.88").select("subject_id", "entry_id", F.round("name_score", 6).alias("name_score"))


def _case_events(spark, sf):
    e = T.load(spark, sf, "events")
    to = F.when(F.col("event_type") == "view", "triage").when(F.col("event_type") == "click", "investigate").when(F.col("event_type") == "purchase", "sar_filed").when(F.col("event_type") == "signup", "closed").otherwise("escalated")
    return e.select((F.col("user_id")).alias("case_id"), F.col("event_id").alias("seq"), to.alias("to_state"), F.concat(F.lit("a"), F.col("event_id") % 3).alias("actor"))


@query(Q.CASES)
def case_replay(spark, sf):
    return C.replay_cases(_case_events(spark, sf)).select("case_id", "seq", "from_state", "to_state", "error", "state", "maker", "checker")


def _opened(spark, sf):
    t = T.aml(spark, sf)
    inputs = t.groupBy("acct").agg(F.max("seq").alias("arrival"), (F.max("amount_minor") % 1000 / 1000).alias("risk")).withColumn("subject_id", F.concat(F.lit("s-"), F.col("acct") % 64))
    names = T.watchlist(spark, sf).select(F.concat(F.lit("s-"), F.col("entry_id") % 200).alias("subject_id"), "entry_id", F.col("name").alias("matched_name"))
    return C.open_cases(inputs, names, C.aml_alerts(t, AML))


@query(Q.OPEN_CASES)
def compliance_cases(spark, sf):
    return C.case_views(_opened(spark, sf), ordered=True).select("case_id", "subject", "risk", "state", F.array_join("alerts", ";").alias("alerts"))


@query(Q.QUEUE)
def queue_filter(spark, sf):
    q = _opened(spark, sf).withColumnRenamed("subject_id", "subject")
    return C.queue_filter(q, status="open", category="aml", text="S-1").select("case_id", "subject", "risk", "tier")


@query(Q.SAR)
def sar_reports(spark, sf):
    a = C.aml_alerts(T.aml(spark, sf), AML).groupBy("acct").agg(F.sort_array(F.collect_set("typology")).alias("typologies"))
    t = T.aml(spark, sf).groupBy("acct").agg(F.sum("amount_minor").alias("total_amount_minor"), F.max(F.col("occurred_at").cast("timestamp")).alias("detected_at"))
    r = C.sar_reports(a.join(t, "acct").select(F.concat(F.lit("case-"), F.col("acct")).alias("case_id"), F.concat(F.lit("acct-"), F.col("acct")).alias("subject"), "typologies", "total_amount_minor", "detected_at"), Sar())
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return r.select("case_id", "subject", F.array_join("typologies", ",").alias("typologies"), "total_amount_minor", "narrative", day("filing_deadline"), day("continuing_activity_review"), "disclose_to_subject")


@query(Q.CTR)
def ctr_reports(spark, sf):
    t = T.aml(spark, sf).select(F.col("acct").cast("string").alias("subject"), F.col("amount_minor").alias("cash_amount_minor"), "occurred_at", "seq")
    return C.ctr_reports(t, Sar(ctr_threshold_minor=40_000_000)).groupBy("subject").agg(F.count("*").alias("n"), F.sum("cash_amount_minor").alias("cash_minor"))


@query(Q.DISPOSITION)
def disposition_labels(spark, sf):
    last = C.replay_cases(_case_events(spark, sf)).groupBy("case_id").agg(F.max_by("state", "seq").alias("state"))
    return C.disposition_labels(last).select("case_id", "state", "value")


@graph_query(Q.EDGES)
def graph_edges(spark, e):
    return G.aggregate_edges(e).select("src", "dst", "n", "total_minor", "last_seen")


@graph_query(Q.DEGREES)
def graph_degrees(spark, e):
    return G.degrees(e)


@graph_query(Q.COUNTS)
def graph_counts(spark, e):
    return G.graph_counts(e)


@graph_query(Q.COMPONENTS)
def graph_components(spark, e):
    return G.components(e)


@graph_query(Q.HUBS)
def fan_in_fan_out(spark, e):
    return G.hubs(e).select("node", "n_sources", F.array_join("members", ",").alias("members"))


@graph_query(Q.SCATTER)
def scatter_gather(spark, e):
    return G.scatter_gather(e)


@graph_query(Q.RINGS)
def temporal_rings_k4(spark, e):
    return G.temporal_rings(e, 4).select("ring", F.col("length").cast("long").alias("length"))


@query()
def temporal_rings(spark, sf):
    """Rings of any length among the transfers of 150 or more; without such a threshold their number explodes."""
    return G.temporal_rings(T.edges(spark, sf, 15_000)).select("ring", F.col("length").cast("long").alias("length"))


@graph_query(Q.DISTANCE)
def dist_to_bad(spark, e):
    return G.distance_to_bad(e, G.bad_nodes(spark, "n1", "n2", "n3"))


def _records(spark, sf):
    t = T.load(spark, sf, "customer")
    one = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    key = F.col("c_custkey")
    return t.select(key.alias("id"), F.array(
        one("device", F.when(key % 7 == 0, F.concat(F.lit(" DEV-"), (key / 49).cast("int"), F.lit(" "))).otherwise(F.lit("  "))),
        one("phone", F.when(key % 11 == 0, F.concat(F.lit("+1 "), (key / 121).cast("int"), F.lit("-00"))).otherwise(F.lit(""))),
        one("name", F.lit("same for all"))).alias("identifiers"))


@query(Q.ENTITIES)
def entity_clusters(spark, sf):
    return G.resolve_entities(_records(spark, sf))


@query(Q.PAGERANK)
def pagerank_n(spark, sf):
    return G.pagerank(T.edges(spark, sf), F.col("amount_minor"), "seq", rounds=5, tolerance=None).select("node", F.round("rank", 8).alias("rank"))


@query(Q.PPR)
def ppr_bad_n(spark, sf):
    return G.pagerank(T.edges(spark, sf), F.col("amount_minor"), "seq", personal=G.bad_nodes(spark, "n1", "n2", "n3"), directed=False, rounds=5, tolerance=None).select("node", F.round("rank", 8).alias("rank"))


@query()
def pagerank_n_all(spark, sf):
    return G.pagerank(T.edges(spark, sf), F.col("amount_minor"), "seq")


@query()
def ppr_bad_n_all(spark, sf):
    return G.pagerank(T.edges(spark, sf), F.col("amount_minor"), "seq", personal=G.bad_nodes(spark, "n1", "n2", "n3"), directed=False)


@query()
def communities(spark, sf):
    return G.communities(T.edges(spark, sf))


@query()
def label_propagation(spark, sf):
    return G.label_propagation(T.edges(spark, sf))


@graph_query(Q.MULE)
def mule_scores(spark, e):
    m = G.mule_scores(G.account_activity(e))
    return m.select("account", F.round("mule_score", 6).alias("mule_score"), F.array_join("signals", ",").alias("signals"), "alert")


@query(Q.APP_FRAUD)
def app_fraud(spark, sf):
    return P.app_fraud(T.p2p(spark, sf)).select("seq", "new_payee", "prior_max", "prior_payers", "app_fraud")


@query(Q.COERCION)
def coercion(spark, sf):
    t = T.txn(spark, sf).select("txn_id", (F.col("k") % 3 == 0).alias("inbound_call"), (F.col("k") % 4 == 0).alias("segmented_typing"), (F.col("k") / 2).alias("dead_time_secs"))
    return P.coercion(t).filter("coercion").select("txn_id", "action", "show_warning")


@graph_query(Q.FREEZE)
def recipient_freeze(spark, e):
    return P.recipient_freeze(G.mule_scores(G.account_activity(e))).select("account", "freeze", "disposition", "file_sar")


@query(Q.ADDRESS_CLUSTERS)
def address_clusters(spark, sf):
    return X.address_clusters(T.ledger(spark, sf))


@query(Q.ADDRESS_CLUSTERS)
def address_clusters_all(spark, sf):
    return X.address_clusters(T.ledger(spark, sf))


@query(Q.LEDGER_VALUE)
def coinjoins(spark, sf):
    return X.coinjoins(X.output_value(T.ledger(spark, sf))).select("txid", "output_minor", "coinjoin")


@query(Q.LEDGER_VALUE)
def coinjoins_all(spark, sf):
    return X.coinjoins(X.output_value(T.ledger(spark, sf))).select("txid", "output_minor", "coinjoin")


def _transfers(spark, sf):
    return T.edges(spark, sf).select("seq", "src", "dst", F.col("amount_minor").alias("value"))


@query()
def taint_exposure(spark, sf):
    return X.exposure(_transfers(spark, sf), G.bad_nodes(spark, "n1", "n2", "n3"))


@query(Q.PEEL)
def peel_chains(spark, sf):
    return X.peel_chains(_transfers(spark, sf), G.bad_nodes(spark, "n1", "n2", "n3"), ratio=0.02, hops=1).select("start", F.col("length").cast("long").alias("length"))


@query(Q.PEEL_3)
def peel_chains_k3(spark, sf):
    return X.peel_chains(_transfers(spark, sf), G.bad_nodes(spark, "n1", "n2", "n3"), ratio=0.015).select("start", F.col("length").cast("long").alias("length"))


@query(Q.PEEL_DEFAULT)
def peel_chains_all(spark, sf):
    return X.peel_chains(_transfers(spark, sf), G.bad_nodes(spark, "n1", "n2", "n3")).select("start", F.col("length").cast("long").alias("length"))


@query(Q.SANCTIONS)
def sanctions_asof(spark, sf):
    o = T.load(spark, sf, "orders")
    tx = o.select("o_orderkey", F.col("o_custkey").alias("address"), F.datediff(F.col("o_orderdate"), F.lit("1992-01-01").cast("date")).alias("day"))
    entries = T.load(spark, sf, "customer").filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("address"), (F.col("c_custkey") % 1000).cast("int").alias("listed_day"), F.when(F.col("c_custkey") % 10 == 0, (F.col("c_custkey") % 1000 + 900).cast("int")).alias("delisted_day"))
    return X.sanctioned(tx, entries).select("o_orderkey", "address", "day", "reason_code")


@query(Q.POISON)
def address_poisoning(spark, sf):
    t = T.txn(spark, sf)
    make = lambda mid: F.concat(F.lit("0xab"), F.lpad(F.col("user_id").cast("string"), 4, "0"), mid, F.lpad((F.col("user_id") % 97).cast("string"), 4, "0"))
    real = t.filter("k % 2 = 0").select(make(F.lit("real")).alias("address"), "us")
    fake = t.filter("k % 2 = 1").select("txn_id", make(F.when(F.col("k") % 3 == 0, "real").otherwise("fake")).alias("address"), "us")
    return X.poisoning(real, fake, 3_600 * 6).select("txn_id", "address", "reason_code")


@query(Q.TRAVEL_RULE)
def travel_rule(spark, sf):
    t = T.txn(spark, sf).select("txn_id", (F.col("amount_minor") * 10).alias("amount_minor"), (F.col("k") % 2 == 0).alias("from_vasp"), (F.col("k") % 3 == 0).alias("to_vasp"), (F.col("k") % 5 == 0).alias("has_originator_data"))
    return X.travel_rule(t).select("txn_id", "amount_minor", "reason_code")


def _labels(spark, sf):
    t = T.txn(spark, sf)
    src = F.when(F.col("k") % 3 == 0, "CHARGEBACK").otherwise("INVESTIGATOR")
    return t.select((F.col("txn_id") % 4000).alias("txn_id"), F.col("txn_id").alias("seq"), F.when(F.col("declined"), "FRAUD").otherwise("LEGIT").alias("value"), src.alias("source"), (F.col("us") + F.when(F.col("k") % 3 == 0, 10).otherwise(1) * L.DAY_US).alias("available_us"))


@query(Q.LABELS)
def labels_resolved(spark, sf):
    return L.resolve(_labels(spark, sf), Q.AS_OF[1]).select("txn_id", "value", "source", "available_us")


@query(Q.DELAYED)
def delayed_labels(spark, sf):
    d = D.decide_rules_only(R.evaluate(T.txn(spark, sf), MIX)).select(F.concat(F.lit("txn-"), F.col("txn_id")).alias("txn_id"), "us", F.col("declined").alias("is_fraud"), "action")
    return L.delayed_labels(d)


@query(Q.RETRAIN)
def retrain_rows(spark, sf):
    s = T.scored(spark, sf)
    inv = s.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("subject"), F.when(F.col("y") == 1, "FRAUD").otherwise("LEGIT").alias("value"))
    return L.retrain_rows(inv, s.filter("doc_id % 2 = 1").select(F.col("doc_id").alias("subject"), F.col("score").alias("p"))).withColumn("weight", F.round("weight", 9))


@query(Q.PSI)
def psi_drift(spark, sf):
    e = T.load(spark, sf, "events")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return M.psi(e.filter(F.col("ts") < cut), e.filter(F.col("ts") >= cut)).select(F.round("psi", 9).alias("psi"), "drift")


@query(Q.PR_AUC)
def pr_auc(spark, sf):
    return M.average_precision(T.scored(spark, sf)).select(F.round("pr_auc", 9).alias("pr_auc"))


@query(Q.RECALL)
def recall_at_fpr(spark, sf):
    return M.recall_at_fpr(T.scored(spark, sf), 0.05).select(*[F.round(c, 9).alias(c) for c in ("recall", "threshold", "alert_to_fraud")])


@query(Q.PRECISION)
def precision_at_n(spark, sf):
    return M.precision_at(T.scored(spark, sf), 50, "doc_id").select(F.round("precision", 9).alias("precision"))


@query(Q.RANKS)
def nearest_rank_latency(spark, sf):
    return M.nearest_rank(T.load(spark, sf, "events"), "value", 0.5, 0.99, 0.999)


@query(Q.MONEY)
def money_formats(spark, sf):
    t = T.txn(spark, sf).withColumn("ccy", F.when(F.col("k") % 4 == 0, "JPY").when(F.col("k") % 4 == 1, "EUR").otherwise("USD"))
    m = F.when(F.col("k") % 2 == 0, -F.col("amount_minor")).otherwise(F.col("amount_minor"))
    return t.select("txn_id", S.money_text(m, F.col("ccy")).alias("text"), S.money(F.col("k").cast("long") - 50, (F.col("amount_minor") % 120).cast("long"), F.col("ccy")).alias("built"))


@query(Q.TIERS)
def risk_tiers(spark, sf):
    s = T.scored(spark, sf)
    return s.select("doc_id", S.risk_tier(F.col("score")).alias("tier"), S.risk_band(F.col("score")).alias("band"), S.valid_score(F.col("score") * 2).isNotNull().alias("valid"))


@query(Q.REQUESTS)
def requests_normalised(spark, sf):
    k, e = F.get_json_object("props", "$.k").cast("int"), T.load(spark, sf, "events")
    r = e.withColumn("k", k).select(
        F.col("event_id").cast("string").alias("idempotency_key"), F.col("event_id").cast("string").alias("transaction_id"), T.minor("value").alias("amount_minor_units"),
        F.when(F.col("k") % 5 == 0, "EUR").when(F.col("k") % 5 == 1, "XXX").when(F.col("k") % 5 == 2, "JPY").otherwise("").alias("currency"), F.when(F.col("k") % 3 == 0, "P2P").otherwise("card").alias("vertical"), F.when(F.col("k") % 4 == 0, "CARD_PRESENT").otherwise("").alias("channel"),
        F.when(F.col("k") % 6 == 0, "").when(F.col("k") % 6 == 1, "123").otherwise(F.concat(F.lit("41111100"), F.lpad(F.col("user_id").cast("string"), 8, "0"))).alias("pan"), F.lit("").alias("merchant"), F.concat(F.lit("d"), "k").alias("device"),
        F.when(F.col("k") % 50 == 0, F.lit(2**60)).otherwise(F.unix_millis(F.col("ts").cast("timestamp"))).alias("occurred_at_unix_ms"), (F.col("k") % 2 * 5411).cast("int").alias("mcc"), F.lit(None).cast("boolean").alias("avs_match"), F.lit(None).cast("boolean").alias("cvv_match"),
        F.when(F.col("k") % 7 == 0, F.concat(F.lit("10.0.0."), "k")).when(F.col("k") % 7 == 1, "300.1.1.1").otherwise("").alias("ip"), F.when(F.col("k") % 2 == 0, "US").otherwise("").alias("geo_country"), F.lit(1.5).alias("geo_lat"), F.lit(2.5).alias("geo_lon"))
    return RQ.normalise(r).select("txn_id", "us", "currency", "vertical", "channel", "bin", "card_token", "merchant", "device", "ip", "mcc", "lat")


@query(Q.TELEMETRY)
def telemetry(spark, sf):
    c = spark.range(160).select(F.element_at(F.array(*[F.lit(x) for x in ("baseline", "fraud-surge", "card-testing", "degrade")]), (F.col("id") % 4 + 1).cast("int")).alias("scenario"), (F.col("id") * 160).cast("double").alias("target_tps"), (F.col("id") % 5 == 0).alias("fault"))
    return SIM.telemetry(c).select("scenario", "target_tps", "fault", "offered", "admitted", "shed", F.round("rho", 6).alias("rho"), "p99", "degrade", "wall_tps", F.round("approve_share", 3).alias("approve_share"))


@query()
def seed_trail(spark, sf):
    return SIM.seed_trail(spark, "baseline", 20_000.0)


@query()
def sim_metrics(spark, sf):
    return SIM.run_scenario(spark, "high_amount", 200)


@query(Q.SIM_TOTALS)
def sim_scenario_totals(spark, sf):
    out = None
    for s in SIM.SCENARIOS:
        d = SIM.run_scenario(spark, s, 100).filter("type = 'metrics'").agg(F.max_by(F.struct("processed", "approved", "declined", "alerts"), F.struct("seq", "ord")).alias("m")).select(F.lit(s).alias("scenario"), "m.*")
        out = d if out is None else out.unionByName(d)
    return out


@query()
def simulated_transactions(spark, sf):
    return SIM.transactions(spark, 20_000)


@query()
def training_metrics(spark, sf):
    """Trains, scores held-out rows and evaluates: one row."""
    from fraudloom.operators import model as ML

    a, b = ML.split(SIM.training_data(spark, 8_000, 0.03))
    s = ML.raw_score(ML.train(a, trees=10, depth=4), b).select("y", F.col("model_score").alias("score"))
    return M.average_precision(s).crossJoin(M.recall_at_fpr(s))  # one row each


def _event_model(spark, sf):
    """Boosted trees that tell declined events by their feature vectors, and those rows."""
    from fraudloom.operators import model as ML

    d = _featured(spark, sf).select(F.col("txn_id").alias("id"), F.col("declined").cast("int").alias("y"), *ML.COLUMNS, "vector")
    d = Scratch(spark, "events").table(d, "features")  # read by each tree and again for the scores
    return ML.train(ML.split(d)[0], trees=8, depth=4), d


@query()
def event_attributions(spark, sf):
    """Exact Shapley values of every event's features under a model trained on events."""
    from fraudloom.operators import model as ML

    model, d = _event_model(spark, sf)
    return ML.shap_reasons(model, ML.attributed(model, d).withColumnRenamed("margin", "total")).select(F.col("id").alias("txn_id"), F.round("total", 9).alias("margin"), F.transform("attributions", lambda v: F.round(v, 9)).alias("attributions"), "shap_reasons")


@query()
def exported_scores(spark, sf):
    """Every event's score by the trained model and by its exported ONNX file."""
    from fraudloom.operators import model as ML

    model, d = _event_model(spark, sf)
    path = Scratch(spark, "onnx").path("trees.onnx")
    ML.export_onnx(model, path, spark)
    d = ML.onnx_scorer(spark, path)(d).withColumnRenamed("model_score", "exported")
    return ML.raw_score(model, d).select(F.col("id").alias("txn_id"), F.round("model_score", 6).alias("model_score"), F.round("exported", 4).alias("exported_score"))


@query()
def reject_inferred(spark, sf):
    from fraudloom.operators import model as ML

    d = SIM.training_data(spark, 4_000, 0.1)
    return ML.reject_inference(d.filter("id % 3 <> 0"), d.filter("id % 3 = 0")).select("id", F.round("p", 6).alias("p"))


@query(Q.HUB_MEMBERS)
def hub_members(spark, sf):
    return G.hub_members(T.edges(spark, sf))


@query(Q.SAME_CLUSTER)
def same_cluster(spark, sf):
    """Each part's address with the next one's, and with one that was never seen."""
    l = T.ledger(spark, sf)
    p = T.load(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    pairs = p.select(F.concat(F.lit("p"), "k").alias("a"), F.when(F.col("k") % 5 == 0, "unseen").otherwise(F.concat(F.lit("p"), F.col("k") + 1)).alias("b"))
    return X.same_cluster(X.address_clusters(l), pairs)


@query(Q.COUNTERPARTY)
def rule_counterparty(spark, sf):
    t = T.txn(spark, sf).withColumn("counterparty", F.when(F.col("k") % 4 > 0, F.concat(F.lit("acct-"), F.col("k") % 30)))
    hits = F.array_compact(F.array(*R.stateless(Rules(deny_counterparties=("acct-7", "acct-13"), high_risk_mcc=()))))
    return t.select("txn_id", "counterparty", F.array_join(R.reason_codes(hits), ",").alias("codes")).filter("codes like '%COUNTERPARTY%'")


@query(Q.WINDOW_MAP)
def window_map(spark, sf):
    d = W.six_windows(T.txn(spark, sf).select(*WINDOWED), "card_token").withColumn("m", W.window_map())
    return d.select("txn_id", F.array_join(F.map_keys("m"), ",").alias("labels"), *[F.col("m")[h][f].cast("long").alias(f"{f}_{h}") for h in ("5m", "7d") for f in ("count", "sum_minor", "distinct_devices", "decline_count")])


@query(Q.MONEY_SUMS)
def money_sums(spark, sf):
    ccy = lambda m: F.when(F.col("k") % m == 0, "JPY").when(F.col("k") % m == 1, "EUR").otherwise("USD")
    big = F.when(F.col("k") == 3, F.lit(2**63 - 1)).otherwise(F.col("amount_minor"))
    return T.txn(spark, sf).select("txn_id", S.money_add(big, ccy(3), F.col("amount_minor"), ccy(4)).alias("added"), S.money_sub(F.col("amount_minor"), ccy(3), big, ccy(4)).alias("less"))


@query(Q.ZIPPED)
def zipped_scores(spark, sf):
    s = T.scored(spark, sf)
    return L.zipped(s.select(F.col("doc_id").alias("pos"), F.concat(F.lit("s"), "doc_id").alias("subject")), s.select(F.col("doc_id").alias("pos"), F.round("score", 9).alias("p")))


@query(Q.STRONG)
def strong_components(spark, sf):
    return RG.strong_components(T.edges(spark, sf))


@query(Q.RINGS_DAY)
def temporal_rings_day(spark, sf):
    """Rings of any length over all transfers, each within a day."""
    return RG.rings_within(T.edges(spark, sf), A.DAY_US).select("ring", F.col("length").cast("long").alias("length"))


@query()
def graph_features(spark, sf):
    return G.feature_rows(T.edges(spark, sf), G.bad_nodes(spark, "n1", "n2", "n3"))


@query(Q.HOPS)
def hop_windows(spark, sf):
    w = F.window(F.col("ts").cast("timestamp"), "1 day", "12 hours")
    return T.load(spark, sf, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "total")


@query(Q.SESSIONS)
def sessions(spark, sf):
    s = F.session_window(F.col("ts").cast("timestamp"), "6 hours")
    return T.load(spark, sf, "events").groupBy(s.alias("s"), "user_id").agg(F.count("*").alias("n")).select(F.unix_micros("s.start").alias("start_us"), "user_id", "n")


@query(Q.MOMENTS)
def window_moments(spark, sf):
    g = T.txn(spark, sf).groupBy("card_token").agg(F.count("*").alias("n"), F.sum("amount_minor").alias("t"), F.sum(F.col("amount_minor").cast("decimal(19,0)") * F.col("amount_minor").cast("decimal(19,0)")).alias("q"))
    return g.select("card_token", F.round(S.window_mean(F.col("n"), F.col("t")), 6).alias("mean"), F.round(S.window_std(F.col("n"), F.col("t"), F.col("q")), 4).alias("std"))
