import random

import pytest
from pyspark.sql import functions as F

from fraudloom.operators import asof as A


def slow(left, right, strict, within):
    out = []
    for i, k, us in left:
        hit = [r for r in right if None not in (k, us, r[0], r[1]) and r[0] == k and (r[1] < us if strict else r[1] <= us)]
        best = max(hit, key=lambda r: (r[1], r[2]), default=None)
        if best and within is not None and us - best[1] > within:
            best = None
        out.append((i, k, us, best[2] if best else None, best[3] if best else None))
    return out


@pytest.mark.parametrize("strict,within,span", [(False, None, 10), (True, None, 7), (False, 5, 1), (True, 12, 1_000_000)])
def test_equals_search(spark, strict, within, span):
    rng = random.Random(span)
    key = lambda: rng.choice(["a", "a", "a", "b", None, "only left"])
    when = lambda: rng.choice([None, *range(-20, 60)])
    left = [(n, key(), when()) for n in range(150)]
    right = [(rng.choice(["a", "b", None, "only right"]), when(), n, rng.choice([None, "x", "y"])) for n in range(120)]
    l = spark.createDataFrame(left + left[:3], "id long, key string, us long").withColumn("row", F.lit(1)).withColumn("a.b", F.lit("t"))
    r = spark.createDataFrame(right, "key string, at long, n long, note string")
    got = A.asof_join(l, r, "key", "us", "at", ["n"], ["n", "note"], span, within, strict=strict)
    assert got.columns == ["id", "key", "us", "row", "a.b", "asof_n", "asof_note"]
    assert sorted(map(str, got.select("id", "key", "us", "asof_n", "asof_note").collect())) == sorted(map(str, [r for r in A_rows(slow(left + left[:3], right, strict, within))]))


def A_rows(rows):
    from pyspark.sql import Row

    return [Row(id=a, key=b, us=c, asof_n=d, asof_note=e) for a, b, c, d, e in rows]


def test_empty_sides(spark):
    l = spark.createDataFrame([(1, "a", 5)], "id long, key string, us long")
    r = spark.createDataFrame([("a", 5, 1)], "key string, at long, n long")
    assert A.asof_join(l, r.limit(0), "key", "us", "at", ["n"], ["n"]).collect()[0].asof_n is None
    assert A.asof_join(l.limit(0), r, "key", "us", "at", ["n"], ["n"]).collect() == []


@pytest.mark.parametrize("span", [1, 9, 10_000])
def test_previous_row_over_borders(spark, span):
    rng = random.Random(span)
    rows = [(n, rng.choice(["a", "b", None, ""]), rng.randrange(50), rng.choice([None, 1, 2])) for n in range(120)]
    got = {r.id: r.before for r in A.previous(spark.createDataFrame(rows, "id long, key string, us long, v int"), "key", "us", ["id"], ["v"], ["before"], span).collect()}
    want = {}
    for k in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))
        want |= {r[0]: (p[3] if p else None) for p, r in zip([None, *mine], mine)}
    assert got == want


def test_a_busy_key_is_many_tasks(spark):
    """No task of the windows sees more than a chunk of the key that all rows share."""
    n = 20_000
    r = spark.range(n).select(F.lit("hot").alias("key"), (F.col("id") * 10).alias("at"), "id")
    l = spark.range(n).select(F.col("id").alias("q"), F.lit("hot").alias("key"), (F.col("id") * 10 + 5).alias("us"))
    out = A.asof_join(l, r, "key", "us", "at", ["id"], ["id"], span_us=n // 4)
    assert out.filter("asof_id = q").count() == n
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    parts = out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(parts) > 1 and max(x["count"] for x in parts) < n


@pytest.mark.parametrize("limit", [0, 10**9])
def test_lagged_windows_are_the_same_either_way(spark, sf_dir, monkeypatch, limit):
    from fraudloom.operators import windows as W
    from fraudloom.sources import tables as T

    monkeypatch.setattr(W, "SLIDING", limit)
    t = T.txn(spark, sf_dir).filter("txn_id < 300")
    got = {r.txn_id: (r.cnt_24h, r.sum_30d, r.dev_7d) for r in W.lagged(t).collect()}
    own = {}
    for r in sorted(W.six_windows(t, "card_token").collect(), key=lambda r: (r.us, r.txn_id)):
        assert got[r.txn_id] == own.get(r.card_token, (None, None, None))
        own[r.card_token] = (r.cnt_24h, r.sum_30d, r.dev_7d)
