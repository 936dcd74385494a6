"""Components after contraction to smallest neighbours beside plain search, and how few edges it leaves."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from fraudloom.operators import crypto as X
from fraudloom.operators.components import connected_components, contracted
from fraudloom.scratch import Scratch


def roots(pairs):
    of = {}
    for a, b in pairs:
        g = of.get(a, {a}) | of.get(b, {b})
        of |= dict.fromkeys(g, g)
    return {x: min(g) for x, g in of.items()}


def test_same_components_and_few_edges(spark):
    r = random.Random(8)
    dense = [(f"d{r.randrange(100):03}", f"d{r.randrange(100):03}") for _ in range(3_000)]
    thin = [(f"t{a:03}", f"t{b:03}") for _ in range(60) for a in [r.randrange(80)] for b in [r.randrange(80)]]
    chain = [(f"c{k:03}", f"c{k + 1:03}") for k in range(70)] + [("z", "z")]
    s = Scratch(spark, "test")
    low, rest = contracted(s, spark.createDataFrame(dense + thin + chain + [b[::-1] for b in thin], "u string, v string"))
    assert rest.filter("u like 'd%'").count() < 100  # of some 2,600 different ones
    label = {x.node: x.label for x in low.collect()}
    root = {x.node: x.root for x in connected_components(s, rest).collect()}
    want = roots(dense + thin + chain)
    assert {x: root.get(label.get(x, x), label.get(x, x)) for x in want} == want


def test_transactions_are_read_once(spark, tmp_path):
    """Clusters and both sides of same_cluster come out of one pass over the ledger."""
    seen = spark.sparkContext.accumulator(0)
    rows = [(f"t{k}", [f"p{k % 7}", f"p{k % 11}"], [(f"s{k % 3}", 5)]) for k in range(40)]

    @F.udf("string")
    def noted(x):
        seen.add(1)
        return x

    ledger = spark.createDataFrame(rows, "txid string, inputs array<string>, outputs array<struct<address string, value long>>").withColumn("txid", noted("txid")).filter("txid is not null")
    pairs = spark.createDataFrame([("p1", "p2"), ("p1", "s1"), ("p1", "never")], "a string, b string")
    assert [x.same for x in X.same_cluster(X.address_clusters(ledger), pairs).orderBy("b").collect()] == [False, True, False]
    assert seen.value == len(rows)
