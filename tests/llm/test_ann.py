import math

import numpy as np
from pyspark.sql import functions as F

from fraudloom.llm import ann


def exact(ids, x, q, k=20):
    i = ids.index(q)
    s = [(-math.fsum(a * b for a, b in zip(x[j], x[i])), ids[j]) for j in range(len(ids)) if j != i]
    return [v for _, v in sorted(s)[:k]]


def test_footrule_matches_its_definition():
    rng = np.random.default_rng(0)
    x, piv = rng.normal(size=(50, 8)), rng.normal(size=(20, 8))
    s = ann.Shard(np.arange(50), x, piv, 6)
    o = ann.order(x, piv, 6)
    for i in (0, 7):
        saved = s.saved(o[i])
        for j in range(50):
            pos = lambda r, p: list(r).index(p) if p in r else 6
            f = sum(abs(pos(o[i], p) - pos(o[j], p)) for p in set(o[i]) | set(o[j]))
            assert 6 * 7 - saved[j] == f


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    got = {}
    for r in ann.query(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    ids, x = [a for a, _ in rows], np.array([b for _, b in rows], float)
    hit = 0
    for q in got:
        i = ids.index(q)
        s = x @ x[i]
        s[i] = -9
        hit += len({v for _, v, _ in got[q]} & {ids[j] for j in np.lexsort((ids, -s))[:20]})
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, 21))
        assert all(abs(sc - x[ids.index(v)] @ x[i]) < 1e-12 for _, v, sc in got[q])
    assert set(got) == {v for v in ids if v % 20 == 0} and hit / (20 * len(got)) >= 0.9


def test_common_vector_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(1)
    hot = rng.normal(size=6).tolist()
    rows = [(k, hot if k % 3 == 0 else rng.normal(size=6).tolist()) for k in range(300)]
    bad = [(999, [1.0]), (1000, None), (1020, []), (1040, [0.0] * 6), (1060, [float("nan")] + [1.0] * 5), (1080, [None] + [1.0] * 5), (1100, [float("inf")] + [1.0] * 5), (1120, [1.0, 2.0]), (None, hot)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("shard", F.lit("clash")).withColumn("rank", F.lit(0))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, shard=64, factor=100.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    ids, x = [a for a, _ in rows], [b for _, b in rows]
    assert set(got) == {k for k in ids if k % 20 == 0}
    for q, g in got.items():
        assert [v for _, v in sorted(g)] == exact(ids, x, q), q


def test_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect()) == [(0, 1, 0), (0, 2, 1)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_over_several_full_shards(spark):
    """52,000 vectors without any clusters, the hardest case, four shards, default settings."""
    n, dim = 52_000, 64
    df = spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[F.randn(k) for k in range(dim)]).alias("embedding")).cache()
    rows = df.toPandas().sort_values("vec_id")
    x = np.stack(rows["embedding"].to_numpy())
    assert -(-n // ann.SHARD) == 4 and ann.reranked(n // 4) < 0.1 * n / 4
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 1000 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(found & set(np.argsort(-s)[:20].tolist()))
    print("recall", hit / (20 * len(got)))
    assert len(got) == 52 and hit / (20 * len(got)) >= 0.9


def test_share_has_one_rule():
    assert [ann.reranked(n) for n in (0, 5, 20, 100, 2_000, 16_384)] == [0, 5, 20, 43, 348, 1516]
