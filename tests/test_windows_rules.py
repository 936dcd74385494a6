import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fraudloom.config import Rules, Velocity, load_aml, load_rules, ConfigError, Reloader
from fraudloom.operators import decide as D
from fraudloom.operators import rules as R
from fraudloom.operators import windows as W

COLS = "txn_id long, us long, amount_minor long, card_token string, bin string, device string, ip string, merchant string, counterparty string, mcc int, avs_match boolean, cvv_match boolean, declined boolean, lat double, lon double"
S = 1_000_000


def txn(spark, rows):
    full = []
    for k, r in enumerate(rows):
        d = dict(txn_id=k, us=0, amount_minor=100, card_token="c", bin="b", device="d", ip=None, merchant=None, counterparty=None, mcc=None, avs_match=None, cvv_match=None, declined=False, lat=None, lon=None) | r
        full.append(tuple(d[c.split()[0]] for c in COLS.split(", ")))
    return spark.createDataFrame(full, COLS)


def test_whole_second_edge_of_features_and_exact_edge_of_rules(spark):
    d = txn(spark, [dict(us=0), dict(us=60_999_000)])
    assert W.six_windows(d, "card_token").filter("txn_id = 1").first().cnt_1m == 2
    assert W.six_windows(txn(spark, [dict(us=0), dict(us=61_000_000)]), "card_token").filter("txn_id = 1").first().cnt_1m == 1
    rules = Rules(card_testing=Velocity(60, 1, 200))
    fires = lambda us: txn(spark, [dict(us=0), dict(us=us)]).withColumn("f", R.card_testing(rules)).filter("txn_id = 1").first().f
    assert fires(60 * S) and not fires(60 * S + 1)


def test_squares_do_not_overflow(spark):
    d = W.six_windows(txn(spark, [dict(amount_minor=5_000_000_000)]), "card_token").first()
    assert d.sq_1m == Decimal(25 * 10**18)


def brute(events, now_k, secs, ties):
    e = events[now_k]
    out = [x for k, x in enumerate(events) if x["card_token"] == e["card_token"] and 0 <= (e["us"] - x["us"]) <= secs * S + 999_999 and (ties == "peers" or k <= now_k or x["us"] < e["us"])]
    return len(out), sum(x["amount_minor"] for x in out), len({x["device"] for x in out} - {None}), sum(x["declined"] for x in out)


def test_windows_against_brute_force(spark):
    r = random.Random(2)
    ev = sorted((dict(us=r.randrange(0, 200) * 500_000, amount_minor=r.randrange(1, 900), card_token=r.choice("ab"), device=r.choice(["x", "y", None]), declined=r.random() < 0.3) for _ in range(60)), key=lambda x: x["us"])
    for ties in ("peers", "arrival"):
        got = {x.txn_id: x for x in W.six_windows(txn(spark, ev), "card_token", ties=ties).collect()}
        for k in range(60):
            g = got[k]
            assert (g.cnt_1m, g.sum_1m, g.dev_1m, g.dec_1m) == brute(ev, k, 60, ties), (ties, k)


def test_point_in_time_ignores_the_future(spark):
    d = txn(spark, [dict(us=0), dict(us=50 * S), dict(us=200 * S)])
    asof = spark.createDataFrame([("c", 100 * S), ("z", 5)], "card_token string, as_of_us long")
    got = {r.card_token: r for r in W.point_in_time(d, asof, "card_token").collect()}
    assert got["c"].cnt_1m == 1 and got["c"].cnt_5m == 2 and got["z"].cnt_30d == 0


def test_lag_and_deviations(spark):
    d = W.deviations(W.lagged(txn(spark, [dict(us=k * S, amount_minor=a) for k, a in enumerate((100, 100, 400))])))
    a = {r.txn_id: r for r in d.collect()}
    assert a[0].cnt_30d is None and a[0].amount_ratio == 1.0 and a[0].amount_zscore == 0.0
    assert a[2].cnt_30d == 2 and a[2].amount_ratio == 4.0 and a[2].amount_zscore == 0.0


def codes(df, k):
    return [h.reason_code for h in df.filter(F.col("txn_id") == k).first().hits]


def test_rules_fire(spark):
    t = txn(spark, [dict(us=k * S, amount_minor=100) for k in range(7)])
    e = R.evaluate(t, Rules())
    assert codes(e, 4) == [] and "VELOCITY_CARD_TESTING" in codes(e, 5)
    b = R.evaluate(txn(spark, [dict(us=k * S, amount_minor=900, card_token=f"c{k}", device=f"d{k}") for k in range(12)]), Rules())
    assert codes(b, 9) == [] and codes(b, 10) == ["VELOCITY_BIN_ATTACK"]
    r = R.evaluate(txn(spark, [dict(us=k * S, amount_minor=900, declined=k < 6, device=f"d{k}") for k in range(7)]), Rules())
    assert codes(r, 5) == [] and codes(r, 6) == ["VELOCITY_DECLINE_RETRY"]
    g = R.evaluate(txn(spark, [dict(us=0, lat=40.71, lon=-74.0, amount_minor=900), dict(us=30 * S, amount_minor=900), dict(us=60 * S, lat=35.68, lon=139.69, amount_minor=900)]), Rules())
    assert codes(g, 0) == [] and codes(g, 2) == ["IMPOSSIBLE_TRAVEL"]
    m = R.evaluate(txn(spark, [dict(us=k * S * 400, amount_minor=300) for k in range(6)] + [dict(us=9000 * S, amount_minor=100_000)]), Rules())
    assert codes(m, 6) == ["AMOUNT_ANOMALY"]


def test_order_and_null_flags(spark):
    rules = Rules(deny_bins=("b",), deny_devices=("d",), deny_counterparties=("q",))
    e = R.evaluate(txn(spark, [dict(counterparty="q", mcc=7995, avs_match=False, cvv_match=None)]), rules)
    assert codes(e, 0) == ["BLOCKLIST_BIN", "BLOCKLIST_DEVICE", "BLOCKLIST_COUNTERPARTY", "MCC_HIGH_RISK", "AVS_MISMATCH"]


def hits(spark, hard, soft):
    h = [("r", "H", "t", R.HARD)] * hard + [("r", "S", "t", R.SOFT)] * soft
    return spark.createDataFrame([(h,)], f"hits array<{R.HIT}>")


def test_fusion(spark):
    f = lambda h, s: D.fuse_rules(hits(spark, h, s)).first()
    assert [(f(h, s).band, f(h, s).action, f(h, s).score) for h, s in ((0, 0), (0, 1), (0, 2), (0, 3), (1, 0))] == [
        ("LOW", "APPROVE", 0.02), ("MEDIUM", "STEP_UP", 0.5), ("MEDIUM", "STEP_UP", 0.5), ("HIGH", "REVIEW", 0.8), ("VERY_HIGH", "DECLINE", 0.99)]
    g = lambda p, h=0, s=0: D.fuse_expected_cost(hits(spark, h, s).withColumn("model_score", F.lit(p))).first()
    assert [g(p).action for p in (0.02, 0.2, 0.5, 0.6, 0.95)] == ["APPROVE", "STEP_UP", "REVIEW", "HOLD", "DECLINE"]
    assert g(float("nan")).score == 1.0 and g(float("inf")).action == "DECLINE"
    assert g(0.3, h=1).score == 0.99 and g(0.3, s=2).score == 0.5


def test_model_reasons(spark):
    v = spark.range(1).select(F.array(*[F.lit(x).cast("float") for x in (3, 40, 25, 30, 0, 0, 0, 1)]).alias("v"))
    assert v.select(D.model_reasons(F.col("v")).alias("r")).first().r == ["MODEL_AMOUNT_RATIO", "MODEL_HIGH_VELOCITY_1H", "MODEL_HIGH_RISK_MCC"]


def test_idempotency(spark):
    d = spark.createDataFrame([("k", 1, "A"), ("k", 2, "B"), ("", 3, "C"), (None, 4, "D")], "key string, n int, action string")
    assert sorted((r.n, r.action, r.replayed) for r in D.idempotent(d, "key", "n", ["action"]).collect()) == [(1, "A", False), (2, "A", True)]


def test_config(tmp_path):
    p = tmp_path / "r.json"
    p.write_text('{"version": "v2", "blocklists": {"bins": ["411111"]}, "velocity": {"card_testing": {"window_secs": 60}}, "mcc_risk": {"high_risk": [1]}}')
    r = load_rules(str(p))
    assert (r.version, r.deny_bins, r.card_testing, r.high_risk_mcc, r.bin_attack.limit) == ("v2", ("411111",), Velocity(60, 5, 200), (1,), 10)
    again = Reloader(str(p))
    assert again.current() == r
    p.write_text("{")
    assert again.current() == r and again.failures == 1
    p.write_text('{"ctr_threshold_minor": 1}')
    try:
        load_aml(str(p))
        raise AssertionError("a missing field passed")
    except ConfigError:
        pass


def test_golden_point_in_time(spark):
    """Five events 10 s, 120 s, 2 h and 40 d before and 60 s after the moment; 30 d sees three."""
    now = 1_750_000_000 * S
    ages = {10: 100, 120: 200, 7_200: 1_000, 40 * 86_400: 5_000, -60: 9_999}
    d = txn(spark, [dict(us=now - a * S, amount_minor=v) for a, v in ages.items()])
    r = W.point_in_time(d, spark.createDataFrame([("c", now)], "card_token string, as_of_us long"), "card_token").first()
    assert [(r[f"cnt_{h}"], r[f"sum_{h}"], int(r[f"sq_{h}"])) for h in ("1m", "5m", "24h", "30d")] == [(1, 100, 10_000), (2, 300, 50_000), (3, 1_300, 1_050_000), (3, 1_300, 1_050_000)]


@pytest.mark.parametrize("ties", ["peers", "arrival"])
def test_running_totals_against_brute_force(spark, monkeypatch, ties):
    """Both ways of six_windows and point_in_time beside plain counting, with equal moments, null devices and ages at the very edges."""
    r = random.Random(9)
    steps = [0, 1, 999_999, 60_000_000, 60_999_999, 61_000_000, 86_400_999_999, 86_401_000_000, 700_000_000_000, 2_592_000_999_999, 2_592_001_000_000]
    rows = []
    for k in ("a", "b", None):
        us = 10**15
        for _ in range(60):
            us += r.choice(steps)
            rows.append((len(rows), k, us, r.choice([5, 700, 4_000_000_000]), r.choice(["d1", "d2", "d3", None]), r.random() < 0.3))
    d = spark.createDataFrame(rows, "txn_id long, card string, us long, amount_minor long, device string, declined boolean")

    def windows(key, us, seq, secs):
        h = [x for x in rows if x[1] == key and 0 <= us - x[2] <= secs * 1_000_000 + 999_999 and (seq is None or (x[2], x[0]) <= (us, seq))]
        return [len(h), sum(x[3] for x in h), sum(x[3] ** 2 for x in h), sum(x[5] for x in h), len({x[4] for x in h} - {None})]

    names = [f"{p}_{h}" for h in W.HORIZONS for p in ("cnt", "sum", "sq", "dec", "dev")]
    want = {x[0]: [v for s in W.HORIZONS.values() for v in windows(x[1], x[2], x[0] if ties == "arrival" else None, s)] for x in rows}
    asof = spark.createDataFrame([(k, t) for k in ("a", "b", "never") for t in (10**15 - 1, 10**15, rows[40][2], rows[40][2] + 60_999_999, 2 * 10**15)], "card string, as_of_us long")
    then = {(x.card, x.as_of_us): [v for s in W.HORIZONS.values() for v in windows(x.card, x.as_of_us, None, s)] for x in asof.collect()}
    for limit in (0, 10**9):
        monkeypatch.setattr(W, "SLIDING", limit)
        assert {x.txn_id: [int(x[n]) for n in names] for x in W.six_windows(d, "card", ties=ties).collect()} == want
        got = W.point_in_time(d, asof, "card").collect()
        assert {(x.card, x.as_of_us): [int(x[n]) for n in names] for x in got} == then and len(got) == len(then)


def test_one_busy_key_takes_linear_work(spark):
    """300,000 events of one key in one horizon; going through each window would be 10^10 steps."""
    n = 300_000
    d = spark.range(n).select(F.col("id").alias("txn_id"), F.lit("m").alias("merchant"), (F.lit(10**15) + F.col("id") * 1_000_000).alias("us"), F.lit(7).cast("long").alias("amount_minor"), F.concat(F.lit("d"), F.col("id") % 50).alias("device"), (F.col("id") % 4 == 0).alias("declined"))
    out = W.six_windows(d, "merchant").filter(F.col("txn_id") == n - 1).select("cnt_1m", "cnt_24h", "cnt_30d", "dev_30d", "sum_30d", "dec_24h").first()
    assert tuple(out) == (61, 86_401, n, 50, 7 * n, 21_600)


def test_velocity_rules_without_frames_match_the_frames(spark):
    """Null keys, null amounts, ties, chunk borders, window edges; no frame goes back over a window's events for each row."""
    r = random.Random(5)
    pick = lambda *v: r.choice([*v, None])
    rows = [(k, pick(*[1_000_000 * x for x in (0, 1, 9, 10, 11, 40, 41, 79, 80, 81)], *[r.randrange(200_000_000) for _ in range(6)]), pick(50, 150, 250), pick("d1", "d2"), pick("b1", "b2"), pick("c1", "c2", "c3", "c4"), pick(True, False)) for k in range(600)]
    t = spark.createDataFrame(rows, "txn_id long, us long, amount_minor long, device string, bin string, card_token string, declined boolean").filter("us is not null")
    rules = Rules(card_testing=Velocity(10, 4, 200), bin_attack=Velocity(10, 2), decline_retry=Velocity(20, 2))
    plain = t.withColumn("a", R.card_testing(rules)).withColumn("b", R.bin_attack(rules)).withColumn("c", R.decline_retry(rules))
    quick = R.with_decline_retry(R.with_bin_attack(R.with_next_of_card(R.with_card_testing(t, rules, "a"), "n"), rules, "b", "n"), rules, "c")
    key = lambda d: sorted((tuple(x) for x in d.select(*t.columns, "a", "b", "c").collect()), key=lambda x: x[0])
    assert key(plain) == key(quick)
    assert all(len(set(x[k] for x in key(plain))) == 2 for k in (-1, -2, -3))
    full = t.selectExpr("*", "1.0D as lat", "1.0D as lon", "5411 as mcc", "true as avs_match", "true as cvv_match", "'i' as ip", "'m' as merchant", "'c' as counterparty")
    assert "RangeFrame, -" not in R.evaluate(full, rules)._jdf.queryExecution().optimizedPlan().toString()


def test_audit_query_reads_the_events_once(spark, sf_dir):
    from fraudloom.plans.catalog import QUERIES

    assert QUERIES["audit_records"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
