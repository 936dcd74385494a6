import os
import random

import pytest

from fraudloom.sources.stores import LatestStore
from fraudloom.streaming.latest import FANOUT, Runs, latest, upsert_latest


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_any_sequence_of_batches(spark, tmp_path):
    rng, want, path = random.Random(1), {}, str(tmp_path / "kv")
    put = upsert_latest(path, "k", "at", buckets=3)
    for n in range(18):
        rows = [(rng.choice(["a", "b", None, *map(str, range(20))]), rng.randrange(100), f"{n}-{j}") for j in range(6)]
        rows = list({(k, at): (k, at, v) for k, at, v in rows if want.get(k, (-1,))[0] != at}.values())
        for k, at, v in rows:
            if at > want.get(k, (-1,))[0]:
                want[k] = (at, v)
        for _ in range(2 if n in (3, 7, 15) else 1):  # a batch that is repeated gives the same
            put(spark.createDataFrame(rows, "k string, at int, v string"), n)
        if n in (0, 3, 4, 11, 15, 17):
            got = {r.k: (r.at, r.v) for r in latest(spark, path, "k", "at").collect()}
            assert got == want
    runs = Runs(spark, path)
    assert len(runs.live()) <= 2 * FANOUT and (0, 15) in runs.live()
    assert len(runs.all()) < 14  # replaced ones go
    assert [r for r in runs.live(below=16)] == [(0, 15)]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = LatestStore(spark, str(tmp_path_factory.mktemp("store") / "s"), "k", "at")
    s.put(spark.range(40_000).selectExpr("cast(id as string) k", "0 at", "uuid() v"), 0)
    s.put(spark.range(0, 40_000, 100).selectExpr("cast(id as string) k", "1 at", "uuid() v"), 1)
    return s


def test_a_small_put_writes_little(store):
    first, second = (size(f"{store.path}/run={k:012d}-{k:012d}") for k in (0, 1))
    assert second < 0.03 * first
    assert store.table().filter("at = 1").count() == 400 and store.table().count() == 40_000


def test_a_look_up_opens_the_wanted_buckets_only(spark, store):
    keys = spark.createDataFrame([("100",), ("7",), ("none",)], "k string")
    got = store.get(keys)
    assert {(r.k, r.at, r.found) for r in got.collect()} == {("100", 1, True), ("7", 0, True), ("none", None, False)}
    files = {f for f in got.inputFiles()}
    buckets = {f.split("bucket=")[1].split("/")[0] for f in store.table().inputFiles()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert len(buckets) == 16 and files
