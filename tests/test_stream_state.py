"""Streams with typed keyed state and joins of streams, held against batch however the input is cut."""

import os
import random

import pytest
from pyspark.sql import functions as F

from fraudloom.operators import crypto as X
from fraudloom.operators import decide as D
from fraudloom.operators import windows as W
from fraudloom.sources import tables as T
from fraudloom.streaming import pipelines as ST
from fraudloom.streaming import state as S


def cut(df, order, folder, n, first=0, past=False):
    """Writes rows as n files in order, each its own micro-batch: consecutive rows each, or dealt like cards (`past`)."""
    rows = df.orderBy(order).collect()
    parts = [rows[k::n] for k in range(n)] if past else [rows[len(rows) * k // n : len(rows) * (k + 1) // n] for k in range(n)]
    os.makedirs(folder, exist_ok=True)
    for k, part in enumerate(parts):
        tmp = f"{folder}-{first + k}"
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.mode("overwrite").parquet(tmp)
        (name,) = [x for x in os.listdir(tmp) if x.startswith("part-")]
        to = f"{folder}/{first + k:04d}.parquet"
        os.rename(f"{tmp}/{name}", to)
        os.utime(to, (1_700_000_000 + first + k,) * 2)
    return folder


def read(spark, folder, schema):
    return ST.source(spark, folder, schema, maxFilesPerTrigger="1")


def run(df, name, checkpoint):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


class Fake:
    """A value or map state in memory that counts its reads."""

    def __init__(self):
        self.d, self.reads = {}, 0

    def get(self):
        return self.d.get(None)

    def update(self, v):
        self.d[None] = v

    def getValue(self, k):
        self.reads += 1
        return self.d.get(k)

    def updateValue(self, k, v):
        self.d[k] = tuple(list(x) if isinstance(x, list) else x for x in v)

    def removeKey(self, k):
        self.d.pop(k, None)

    def clear(self):
        self.d.clear()


def taken(states, events, batch, keep=S.EDGES[-1] + 86_400_000_000):
    out = []
    for k in range(0, len(events), batch):
        have = S._Key(*states)
        for us, seq, amount, device, declined in events[k : k + batch]:
            late = have.us is not None and us < have.us
            out.append((have.insert if late else have.append)(us, seq, amount, device, declined))
        have.store(keep)
    return out


def plain(events):
    out, seen = [], []
    for e in events:
        seen.append(e)
        row = []
        for edge in S.EDGES:
            w = [x for x in seen if 0 <= e[0] - x[0] <= edge]
            row += [len(w), sum(x[2] for x in w), str(sum(x[2] ** 2 for x in w)), len({x[3] for x in w if x[3] is not None}), sum(x[4] for x in w)]
        out.append(row)
    return out


@pytest.mark.parametrize("seed,size", [(1, 4), (2, 16), (3, 512)])
def test_windows_of_one_key_with_late_events(monkeypatch, seed, size):
    monkeypatch.setattr(S, "CHUNK", size)
    rng = random.Random(seed)
    day, at, events = 86_400_000_000, 0, []
    for k in range(400):
        at += rng.choice([0, 1, 999_999, 30_000_000, 3_000_000_000, day // 3, 9 * day])
        us = at if rng.random() < 0.7 else max(0, at - rng.choice([0, 1, 60_000_000, 61_000_000, day - 1]))
        events.append((us, k, rng.randint(-50, 10**12), rng.choice([None, "a", "b", "c", "d"]), rng.random() < 0.3))
        at = max(at, us)
    want = plain(events)
    for batch in (1, 7, 400):
        states = Fake(), Fake(), Fake()
        assert taken(states, events, batch) == want
        assert len(states[1].d) < 400  # old chunks are gone


def test_cost_of_a_busy_key_is_linear():
    events = [(k * 20_000_000, k, 5, f"d{k % 50}", False) for k in range(20_000)]
    reads, moved = [], []
    for n in (5_000, 20_000):
        states = Fake(), Fake(), Fake()
        count = [0]
        real = S._Key.shift

        def shift(self, *a, real=real, count=count):
            count[0] += 1
            return real(self, *a)

        S._Key.shift = shift
        try:
            out = taken(states, events[:n], 1000)
        finally:
            S._Key.shift = real
        assert out[-1][0] == 4 and out[-1][25] == n
        reads.append(states[1].reads)
        moved.append(count[0])
    assert moved[1] <= 4.5 * moved[0] and moved[1] <= 12 * 20_000
    assert reads[1] <= 5 * reads[0] + 50


@pytest.mark.parametrize("n", [1, 3, 10])
def test_windows_equal_batch_for_any_cut(spark, sf_dir, tmp_path, n):
    txn = T.txn(spark, sf_dir).filter("txn_id < 150").select("txn_id", "us", "amount_minor", "card_token", "device", "merchant", "declined")
    src = read(spark, cut(txn, ["us", "txn_id"], str(tmp_path / "in"), n), txn.schema)
    e = ST.keyed(src).withColumn("seq", F.col("us") * 1000 + F.col("seq"))
    got = run(ST.entity_windows(e, 400 * 86_400), f"win{n}", tmp_path / "cp")
    batch = W.six_windows(W.fan_out(txn.withColumn("seq", F.col("us") * 1000 + F.col("txn_id"))), "entity", seq="seq", ties="arrival")
    want = [tuple(r) for r in batch.select(*[F.col(c).cast("string") if c.startswith("sq_") else F.col(c) for c in S.NAMES]).collect()]
    assert sorted(got) == sorted(want) and len(got) > 400


def test_windows_go_on_after_a_restart(spark, sf_dir, tmp_path):
    txn = T.txn(spark, sf_dir).filter("txn_id < 150").select("txn_id", "us", "amount_minor", "card_token", "declined", "device")
    half = txn.orderBy("us").collect()[75].us
    folder = str(tmp_path / "in")
    cut(txn.filter(F.col("us") < half), ["us", "txn_id"], folder, 2)
    make = lambda: ST.entity_windows(ST.keyed(read(spark, folder, txn.schema)), 400 * 86_400)
    seen = {}

    def keep(batch, n):
        for r in batch.collect():
            assert (r.entity, r.seq) not in seen
            seen[r.entity, r.seq] = tuple(r)

    for step in (0, 1):
        if step:
            cut(txn.filter(F.col("us") >= half), ["us", "txn_id"], folder, 2, first=2)
        make().writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = W.six_windows(W.fan_out(txn), "entity").withColumnRenamed("txn_id", "seq")
    want = [tuple(r) for r in batch.select(*[F.col(c).cast("string") if c.startswith("sq_") else F.col(c) for c in S.NAMES]).collect()]
    assert sorted(seen.values()) == sorted(want)


def test_quiet_keys_are_forgotten(spark, tmp_path):
    day = 86_400_000_000
    rows = [("a", 1, day, 5, "d", False), ("b", 2, 40 * day, 5, None, None), ("a", 3, 41 * day, 7, "d", True)] + [("c", 4 + k, (100 + k) * day, 1, None, False) for k in range(3)] + [("a", 9, 140 * day, 9, "d", False)]
    df = spark.createDataFrame(rows, "entity string, seq long, us long, amount_minor long, device string, declined boolean")
    got = run(ST.entity_windows(read(spark, cut(df, "us", str(tmp_path / "in"), 7), df.schema)), "quiet", tmp_path / "cp")
    last = {r[1]: dict(zip(S.NAMES, r)) for r in got}
    assert last[3]["cnt_30d"] == 1 and last[3]["dec_30d"] == 1 and last[9]["cnt_30d"] == 1 and last[9]["dev_30d"] == 1 and len(got) == 7
    left = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "totals").load()
    assert {r.key.entity for r in left.select("key").collect()} == {"c", "a"}


@pytest.mark.parametrize("n", [1, 3, 10])
def test_replays_equal_batch_for_any_cut(spark, sf_dir, tmp_path, n):
    t = T.txn(spark, sf_dir).filter("txn_id < 300")
    d = t.select("txn_id", "us", (F.col("txn_id") % 70).cast("string").alias("key"), F.when(F.col("declined"), "DECLINE").otherwise("APPROVE").alias("action"), (F.col("amount_minor") / 7).alias("score"), F.when(F.col("txn_id") % 3 > 0, F.col("k")).alias("note"))
    d = d.withColumn("key", F.when(F.col("txn_id") == 5, "").when(F.col("txn_id") == 6, None).otherwise(F.col("key")))
    src = read(spark, cut(d, "txn_id", str(tmp_path / "in"), n), d.schema).withColumn("at", F.timestamp_micros("us"))
    out = ST.replayed(src, "key", "txn_id", ["action", "score", "note"], "at", 900 * 86_400, 900 * 86_400).drop("at")
    got = run(out, f"replay{n}", tmp_path / "cp")
    want = D.idempotent(d, "key", "txn_id", ["action", "score", "note"]).select(*out.columns)
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in want.collect()) and len(got) == 298
    assert sum(r[-1] for r in got) > 200


def test_verdicts_end(spark, tmp_path):
    day = 86_400_000_000
    rows = [(1, "k", "APPROVE", 1), (2, "k", "DECLINE", day // 2), (3, "x", "APPROVE", 9 * day), (4, "x", "APPROVE", 10 * day), (5, "k", "REVIEW", 10 * day + 1)]
    df = spark.createDataFrame(rows, "id long, key string, action string, us long")
    src = read(spark, cut(df, "id", str(tmp_path / "in"), 5), df.schema).withColumn("at", F.timestamp_micros("us"))
    got = sorted((r[0], r[2], r[-1]) for r in run(ST.replayed(src, "key", "id", ["action"], "at"), "ends", tmp_path / "cp"))
    assert got == [(1, "APPROVE", False), (2, "APPROVE", True), (3, "APPROVE", False), (4, "APPROVE", True), (5, "REVIEW", False)]


@pytest.mark.parametrize("n,m,past", [(1, 1, False), (3, 5, False), (4, 2, True)])
def test_poisoning_of_two_streams_equals_batch(spark, sf_dir, tmp_path, n, m, past):
    t = T.txn(spark, sf_dir).filter("txn_id < 600")
    make = lambda mid: F.concat(F.lit("0xab"), F.lpad((F.col("user_id") % 5).cast("string"), 4, "0"), mid, F.lpad((F.col("user_id") % 3).cast("string"), 4, "0"))
    real = t.filter("k % 2 = 0").select(make(F.lit("real")).alias("address"), "us")
    fake = t.filter("k % 2 = 1").select("txn_id", make(F.when(F.col("k") % 3 == 0, "real").otherwise("fake")).alias("address"), "us")
    left = read(spark, cut(real, "us", str(tmp_path / "real"), n, past=past), real.schema)
    right = read(spark, cut(fake, "us", str(tmp_path / "fake"), m, past=past), fake.schema)
    got = run(ST.poisoning(left, right, 3_600, 900 * 86_400), f"poison{n}", tmp_path / "cp")
    want = [tuple(r) for r in X.poisoning(real, fake, 3_600).select("txn_id", "address", "us", "reason_code", "disposition").collect()]
    assert sorted(got) == sorted(want) and 10 < len(got) < fake.count()
