import os

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fraudloom.config import Rules, Velocity
from fraudloom.operators import model as ML
from fraudloom.operators.decide import MODEL_REASONS
from fraudloom.operators import windows as W
from fraudloom.sources import requests as RQ
from fraudloom.sources import simulator as SIM
from fraudloom.sources.stores import CountingSink
from fraudloom.sources import tables as T
from fraudloom.streaming import pipelines as ST


def test_requests(spark):
    row = dict.fromkeys(RQ.REQUEST.names) | dict(idempotency_key="k", transaction_id="t", amount_minor_units=5, currency="XXX", vertical="?", channel="", pan="4111110000001234", merchant="", device="", occurred_at_unix_ms=2**62, mcc=0, ip="999.1.1.1", geo_country="")
    r = RQ.normalise(spark.createDataFrame([tuple(row[n] for n in RQ.REQUEST.names)], RQ.REQUEST)).first()
    assert (r.currency, r.vertical, r.channel, r.bin, r.card_token, r.device, r.us, r.mcc, r.ip, r.lat, r.account) == ("USD", "CARD", "CARD_NOT_PRESENT", "411111", "411111****1234", None, 0, None, None, None, None)
    good = row | dict(ip="10.0.0.1", geo_country="US", geo_lat=1.0, geo_lon=2.0, mcc=7995, occurred_at_unix_ms=1000, currency="JPY")
    r = RQ.normalise(spark.createDataFrame([tuple(good[n] for n in RQ.REQUEST.names)], RQ.REQUEST)).first()
    assert (r.ip, r.lat, r.mcc, r.us, r.currency) == ("10.0.0.1", 1.0, 7995, 1_000_000, "JPY")


def test_generator(spark):
    a = SIM.transactions(spark, 100).orderBy("us").collect()
    assert a == SIM.transactions(spark, 100).repartition(7).orderBy("us").collect()
    assert a[-1].us - a[0].us == 99 * 20_000 and all(100 <= r.amount_minor < 50_000 for r in a) and len({r.card_token for r in a}) > 30
    first = SIM.draw(1, 100 + 50)  # after 100 cards and 50 addresses
    assert a[0].amount_minor == first % 49_900 + 100
    pop = SIM.population(spark, 100, 1)
    assert {k: v.count() for k, v in pop.items()} == SIM.population_sizes(100)
    with pytest.raises(ValueError):
        SIM.transactions(spark, 1, rate=0)


def test_scenarios(spark):
    run = {s: SIM.run_scenario(spark, s, 25).collect() for s in SIM.SCENARIOS}
    for rows in run.values():
        assert [r.processed for r in rows if r.type == "metrics"] == [10, 20, 25] and sum(r.type == "decision" for r in rows) == 25
    assert all(r.action == "DECLINE" for r in run["blocklisted_bin"] if r.type == "decision")
    ct = [r.action for r in run["card_testing"] if r.type == "decision"]
    assert ct[:5] == ["APPROVE"] * 5 and ct[5:] == ["DECLINE"] * 20
    ha = [r.reason_codes for r in run["high_amount"] if r.type == "decision"]
    assert ha[4] == [] and ha[5] == ["AMOUNT_ANOMALY"]
    assert {r.action for r in run["legitimate"] if r.type == "decision"} == {"APPROVE"}
    assert SIM.run_scenario(spark, "nonsense", 0).first().processed == 0 and SIM.scenarios(spark).count() == 4


def test_telemetry(spark):
    c = spark.createDataFrame([("baseline", 10_000.0, False), ("baseline", 25_000.0, True)], "scenario string, target_tps double, fault boolean")
    a, b = SIM.telemetry(c).orderBy("target_tps").collect()
    assert (a.shed, a.degrade, a.p99) == (0, False, pytest.approx(3.8, abs=0.01)) and b.degrade and b.admitted + b.shed == 25_000 and b.p99 == pytest.approx(19.0, abs=0.1)
    assert SIM.seed_trail(spark, "baseline", 20_000).count() == 18
    more = spark.createDataFrame([("card-testing", 18_000.0, False, True), ("degrade", 5_000.0, False, False), ("baseline", 1_000.0, False, None)], "scenario string, target_tps double, fault boolean, running boolean")
    busy, still, idle = SIM.telemetry(more).orderBy(F.desc("target_tps")).collect()
    assert busy.stages[3] == ("graph", 17_865, round((18_000 / 21_500 - 0.72) * 21_500 * 0.5), True) and [s.queue for s in busy.stages if s.stage != "graph"] == [0] * 4 and busy.stages[0].tps == 18_000
    assert (still.offered, still.admitted, still.rho, still.p50, still.p99, still.degrade, still.approve_share) == (0, 0, 0.0, 0.0, 3.0, False, 0.0) and [(s.tps, s.queue, s.bottleneck) for s in still.stages] == [(0, 0, False)] * 4 + [(0, 0, True)]
    assert idle.offered == 1_000 and all(s.queue == 0 for s in idle.stages)


@pytest.fixture(scope="module")
def trained(spark):
    d = SIM.training_data(spark, 3_000, 0.05).cache()
    a, b = ML.split(d)
    return d, ML.train(a, trees=5, depth=3), b


def test_training(spark, trained, tmp_path):
    from fraudloom.operators.metrics import average_precision

    d, m, held = trained
    s = ML.raw_score(m, held)
    assert average_precision(s.select("y", F.col("model_score").alias("score"))).first().pr_auc > 0.7
    c = ML.calibrate(s).transform(s).agg(F.min("calibrated"), F.max("calibrated")).first()
    assert 0 <= c[0] <= c[1] <= 1
    fixture = ML.export(m, str(tmp_path / "m"), d)
    assert len(fixture["scores"]) == 32 and ML.parity(spark, str(tmp_path / "m"), fixture) < 1e-9


def test_attributions_add_up(spark, trained):
    d, m, _ = trained
    for r in ML.raw_score(m, ML.attributed(m, d.limit(50))).collect():
        assert 1 / (1 + np.exp(-2 * r.margin)) == pytest.approx(r.model_score, abs=1e-6)
    fraud = ML.shap_reasons(m, d.filter("y = 1").limit(3)).collect()
    assert all(0 < len(r.shap_reasons) <= 3 for r in fraud) and {c for r in fraud for c in r.shap_reasons} <= {c for c, _ in MODEL_REASONS}


def _field(n, value):
    """One protobuf field: whole numbers as varints, bytes with their length."""
    varint = lambda v: bytes([v & 127 | 128]) + varint(v >> 7) if v > 127 else bytes([v])
    return varint(n << 3) + varint(value) if isinstance(value, int) else varint(n << 3 | 2) + varint(len(value)) + value


def test_onnx_scorer(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    w, bias = np.arange(16, dtype=np.float32).reshape(8, 2) / 50, np.array([0.1, -0.2], np.float32)
    tensor = lambda name, a: b"".join(_field(1, k) for k in a.shape) + _field(2, 1) + _field(8, name) + _field(9, a.tobytes())
    node = lambda op, ins, out: b"".join(_field(1, x) for x in ins) + _field(2, out) + _field(4, op)
    shape = lambda name, dims: _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, b"".join(_field(1, d) for d in dims))))
    graph = _field(1, node(b"Gemm", [b"x", b"w", b"b"], b"z")) + _field(1, node(b"Softmax", [b"z"], b"probabilities")) + _field(2, b"g") + _field(5, tensor(b"w", w)) + _field(5, tensor(b"b", bias))
    graph += _field(11, shape(b"x", [_field(2, b"n"), _field(1, 8)])) + _field(12, shape(b"probabilities", [_field(2, b"n"), _field(1, 2)]))
    path = tmp_path / "m.onnx"
    path.write_bytes(_field(1, 8) + _field(7, graph) + _field(8, _field(1, b"") + _field(2, 13)))
    x = [[float((3 * k + j) % 5) for j in range(8)] for k in range(30)]
    d = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "id long, vector array<float>")
    got = [r.model_score for r in ML.onnx_scorer(spark, str(path))(d).orderBy("id").collect()]
    z = np.array(x) @ w + bias
    assert got == pytest.approx((np.exp(z[:, 1]) / np.exp(z).sum(1)).tolist(), abs=1e-6)


def test_training_data_has_both_populations(spark):
    d = SIM.training_data(spark, 20_000, 0.1)
    m = {r.y: r for r in d.groupBy("y").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ML.COLUMNS], F.min("f_amount_ratio").alias("least")).collect()}
    want = {0: [1, 3, 10, 1, 0, 1, 1 / 21, 0.03], 1: [5, 15, 40, 5, 3, 4, 0.4, 0.3]}
    assert (m[0].n, m[1].n) == (18_000, 2_000) and m[1].least >= 0
    for y, mean in want.items():
        assert [m[y][c] for c in ML.COLUMNS] == pytest.approx(mean, rel=0.06, abs=0.05)
    assert sorted(d.collect()) == sorted(SIM.training_data(spark, 20_000, 0.1).repartition(3).collect())


def test_packs_and_placeholder(spark, sf_dir):
    from fraudloom.operators import decide as D
    from fraudloom.operators import rules as R

    d = R.evaluate(T.txn(spark, sf_dir).filter("txn_id < 50"), Rules(version="v"))
    pack = F.when(F.col("txn_id") % 2 == 0, R.hit("crypto.sanctions", "CRYPTO_SANCTIONS", "sanctions", R.HARD))
    out = D.decide_rules_only(D.with_packs(d, pack)).collect()
    assert all((r.reason_codes[-1:] == ["CRYPTO_SANCTIONS"]) == (r.txn_id % 2 == 0) for r in out) and all(r.action == "DECLINE" for r in out if r.txn_id % 2 == 0)
    assert {(r.action, r.score, r.rule_version) for r in D.approve_all(d).collect()} == {("APPROVE", 0.0, "rules-v0")}


def test_reject_inference(spark):
    acc = spark.createDataFrame([(float(k), int(k > 5)) for k in range(12)], "x double, y int")
    rej = spark.createDataFrame([(0.0,), (11.0,)], "x double")
    lo, hi = [r.p for r in ML.reject_inference(acc, rej, ["x"]).orderBy("x").collect()]
    assert lo < 0.2 and hi > 0.8
    assert ML.reject_inference(acc.limit(0), rej, ["x"]).count() == 0


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    txn = T.txn(spark, sf_dir).filter("txn_id < 400").select("txn_id", "us", "amount_minor", "card_token", "bin", "device", "ip", "merchant", "declined")
    txn.repartition(1).sortWithinPartitions("txn_id").write.parquet(str(tmp_path / "in"))
    src = ST.source(spark, str(tmp_path / "in"), txn.schema)
    q = ST.entity_windows(ST.keyed(src)).writeStream.format("memory").queryName("ent").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    names = [c.split()[0] for c in ST.OUT.split(", ")]
    got = {tuple(r) for r in spark.table("ent").select(*names).collect()}
    batch = W.six_windows(W.fan_out(txn), "entity").withColumnRenamed("txn_id", "seq")
    want = {tuple(r) for r in batch.select(*[F.col(n).cast("string") if n.startswith("sq_") else F.col(n) for n in names]).collect()}
    assert got == want and len(got) > 1000


def test_stream_decisions_audit_and_store(spark, sf_dir, tmp_path):
    txn = T.txn(spark, sf_dir).filter("txn_id < 200")
    txn.write.parquet(str(tmp_path / "in"))
    q = ST.decisions(ST.source(spark, str(tmp_path / "in"), txn.schema), ST.append_audit(str(tmp_path / "audit")), str(tmp_path / "cp"), Rules(version="live"))
    q.awaitTermination()
    a = spark.read.parquet(str(tmp_path / "audit"))
    assert a.count() == 200 and a.select("rule_version").distinct().first()[0] == "live"
    count = CountingSink()
    ST.decisions(ST.source(spark, str(tmp_path / "in"), txn.schema), count, str(tmp_path / "cp2")).awaitTermination()
    assert count.rows == 200
    count(txn.limit(3), 7)
    count(txn.limit(3), 7)
    assert count.rows == 203
    put = ST.upsert_latest(str(tmp_path / "kv"), "card_token", "us")
    now = lambda: ST.latest(spark, str(tmp_path / "kv"), "card_token", "us")
    assert now() is None
    one = txn.select("card_token", "us", "amount_minor")
    put(one.filter("txn_id < 100"), 0)
    put(one.filter("txn_id >= 100"), 1)
    put(one.filter("txn_id >= 100"), 1)
    kv = now().cache()  # later merges replace the folders it was read from
    kv.count()
    assert sorted(os.listdir(tmp_path / "kv")) == [f"run={k:012d}-{k:012d}" for k in (0, 1)]
    assert kv.count() == one.select("card_token").distinct().count() and kv.agg(F.max("us")).first()[0] == one.agg(F.max("us")).first()[0]
    for n in range(2, 17):
        put(one.filter(F.col("us") == kv.agg(F.min("us")).first()[0]).withColumn("us", F.col("us") + n), n)
    assert "run=000000000000-000000000015" in os.listdir(tmp_path / "kv") and now().count() == kv.count() and now().agg(F.min("us")).first()[0] > kv.agg(F.min("us")).first()[0]
    fresh = ST.with_freshness(txn, kv.select("card_token", "us"), "card_token", 0)
    assert fresh.filter("feature_status = 'OK'").count() == 200


def test_velocity_rules_see_earlier_batches(spark, sf_dir, tmp_path, monkeypatch):
    """Batch equals stream row by row for all five rules, however the input is cut, with and without folded batches."""
    from fraudloom.operators import rules as R
    from fraudloom.plans.catalog import FIXTURE

    tight = Rules(**{**FIXTURE.__dict__, "card_testing": Velocity(86_400, 1, 1_500), "bin_attack": Velocity(21_600, 1), "decline_retry": Velocity(259_200, 1), "anomaly_min_samples": 2, "anomaly_factor": 2.0})
    every = T.txn(spark, sf_dir)
    places = [r.us for r in every.select("us").orderBy("us").collect()]
    every = every.withColumn("txn_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("us", "txn_id")))  # in order of time
    want = {r.txn_id: r.codes for r in R.evaluate(every, tight).select("txn_id", R.reason_codes(F.col("hits")).alias("codes")).collect()}
    fired = {c for codes in want.values() for c in codes}
    assert {"VELOCITY_CARD_TESTING", "VELOCITY_BIN_ATTACK", "VELOCITY_DECLINE_RETRY", "IMPOSSIBLE_TRAVEL", "AMOUNT_ANOMALY"} <= fired
    monkeypatch.setattr(ST.History, "MERGE", 2)
    for cuts in ([0.5], [0.1, 0.2, 0.55, 0.7, 0.8, 0.9]):
        past, got = ST.History(spark, str(tmp_path / f"h{len(cuts)}")), {}
        edges = [places[0] - 1, *(places[int(c * len(places))] for c in cuts), places[-1]]
        for n, (a, b) in enumerate(zip(edges, edges[1:])):
            batch = every.filter((F.col("us") > a) & (F.col("us") <= b))
            for _ in range(2 if n == 1 else 1):  # a batch that is repeated gives the same
                rows = past.evaluate(batch, n, tight)
                got |= {r.txn_id: r.codes for r in rows.select("txn_id", R.reason_codes(F.col("hits")).alias("codes")).collect()}
                past.add(batch, n)
        assert got == want
    assert past._folders("cards", "upto=")


def test_stream_windows_sessions_dedup_metrics(spark, sf_dir, tmp_path):
    e = T.load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    src = lambda: ST.source(spark, str(tmp_path / "in"), e.schema)

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    assert run(ST.tumbling_windows(src()), "tumble").count() > 0
    assert run(ST.hop_windows(src()), "hop").count() > 0
    assert run(ST.sessions(src()), "sess").count() > 0
    keyed = src().select(F.concat(F.lit("k"), F.col("event_id") % 50).alias("idempotency_key"), F.col("ts").alias("occurred_at"))
    assert run(ST.deduplicated(keyed, late="400 days"), "dedup").count() == 50
    m = run(ST.running_metrics(src().select(F.lit("DECLINE").alias("action"), F.array(F.lit("x")).alias("reason_codes"))), "mets", "complete").first()
    assert m.processed == e.count() == m.declined and m.decline_rate == 1.0
