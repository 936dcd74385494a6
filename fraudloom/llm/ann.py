"""Approximate nearest neighbours (operator 6): permutation index.

A vector is represented by its PREFIX nearest of PIVOTS pivots, in order. Each
index shard posts its vectors in pivot inverted files (pivot -> vector,
position). A query walks the files of its own pivots and accumulates what the
footrule distance of the two prefixes saves against disjoint ones; the best
candidates are reranked by the exact inner product. Pivots are a bounded
sample; every row is indexed. Equal vectors of a shard are indexed once, with
all their smallest ids.

Queries go to every shard in blocks; groups are bounded by SHARD and QUERIES.
Work is queries times rows: vectors without clusters allow no pruning at this
recall, and what a pair of groups shuffles is small beside its comparisons.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

PIVOTS = 512
PREFIX = 64
SHARD = 16_384
QUERIES = 32_768
K = 20
FACTOR, POWER = 1.7, 0.7


def reranked(n: int, k: int = K, factor: float = FACTOR, power: float = POWER) -> int:
    """How many of n distinct vectors are reranked: factor * n^power, k at least, by one rule at every size.

    The exponent is below 1 because the nearest of more vectors are nearer,
    so their permutations stand out more.
    """
    return min(n, max(k, math.ceil(factor * n**power)))


def usable(v) -> "F.Column":
    """Not null, not empty, without null or non-finite parts, not zero."""
    c = F.col(v)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(c, lambda x: x != 0)


def order(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The prefix nearest pivots of each vector, nearest (largest cosine) first, ties to the lower pivot."""
    sims = x @ pivots.T
    return np.argsort(-sims, axis=1, kind="stable")[:, :prefix]


class Shard:
    """Inverted files over the distinct vectors of one shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, prefix: int):
        by = np.argsort(ids, kind="stable")
        ids, x = ids[by], np.ascontiguousarray(x[by] + 0.0)
        rows = x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
        _, first, which = np.unique(rows, return_index=True, return_inverse=True)
        rank = np.argsort(np.argsort(first))  # distinct vectors numbered by their smallest id
        self.which = rank[which]
        self.x = x[np.sort(first)]
        self.ids = ids
        member = np.argsort(self.which, kind="stable")
        self.member, self.start = member, np.searchsorted(self.which[member], np.arange(len(self.x) + 1))
        o = order(self.x, pivots, prefix)
        self.prefix = o.shape[1]
        flat = o.ravel()
        at = np.argsort(flat, kind="stable")
        self.vector = (at // self.prefix).astype(np.int32)
        self.place = (at % self.prefix).astype(np.int32)
        self.file = np.searchsorted(flat[at], np.arange(len(pivots) + 1))

    def saved(self, q: np.ndarray) -> np.ndarray:
        """2 * sum over shared pivots of min(m - i, m - j): the footrule is m * (m + 1) less this."""
        m = self.prefix
        parts = [(self.vector[a:b], np.minimum(m - i, m - self.place[a:b])) for i, p in enumerate(q.tolist()) for a, b in [self.file[p : p + 2]]]
        return 2 * np.bincount(np.concatenate([v for v, _ in parts]), np.concatenate([w for _, w in parts]), len(self.x)).astype(np.int64)

    def search(self, qid: int, qx: np.ndarray, q: np.ndarray, k: int, factor: float, power: float) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.x)
        c = reranked(n, k, factor, power)
        if c < n:
            key = self.saved(q) * n + (n - 1 - np.arange(n))  # ties to the vector with the smaller id
            cand = np.sort(np.argpartition(-key, c - 1)[:c])
        else:
            cand = np.arange(n)
        s = (self.x[cand] * qx).sum(axis=1)
        ids: list[int] = []
        score: list[float] = []
        kth = None
        for t in np.lexsort((cand, -s)).tolist():
            if kth is not None and s[t] < kth - 1e-9:
                break
            v = cand[t]
            mine = self.ids[self.member[self.start[v] : self.start[v + 1]]]
            own = np.flatnonzero(mine == qid)
            if len(own):  # only the query's own row is left out, not its equals
                mine = np.delete(mine, own[0])
            mine = mine[:k]
            ids += mine.tolist()
            score += [math.fsum(self.x[v] * qx)] * len(mine)
            if kth is None and len(ids) >= k:
                kth = s[t]
        found, value = np.array(ids, np.int64), np.array(score)
        best = np.lexsort((found, -value))[:k]
        return found[best], value[best]


_FOUND = "query_id long, vec_id long, score double"


def nearest(embeddings: DataFrame, is_query, k: int = K, pivots: int = PIVOTS, prefix: int = PREFIX, shard: int = SHARD, factor: float = FACTOR, power: float = POWER) -> DataFrame:
    """embeddings (vec_id, embedding) -> (query_id, rank, vec_id, score) of the rows where is_query (a condition on vec_id) holds.

    In each shard the nearest of its vectors by footrule are reranked, as
    many as reranked() says; scores are correctly rounded sums of the
    products. Vectors that are null, empty, zero or hold null or non-finite
    parts take no part, nor do rows with a null vec_id or with another
    dimension than most vectors have (of two as frequent the larger). Repeated rows are candidates each; a repeated query
    id is asked once, with its smallest vector. No rows for an empty table.
    """
    spark = embeddings.sparkSession
    common.prepare(spark)
    v = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & usable("embedding"))
    most = v.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = v.filter(F.size("embedding") == most.dim)
    piv = np.unique(np.array([r.embedding for r in v.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(pivots).collect()]), axis=0)
    piv /= np.linalg.norm(piv, axis=1, keepdims=True)
    n, nq = v.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-nq // QUERIES))
    given = spark.sparkContext.broadcast(piv)  # pivots x dimension

    def search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        files = Shard(index["vec_id"].to_numpy(np.int64), np.stack(index["embedding"].to_numpy()), given.value, prefix)
        qx = np.stack(queries["embedding"].to_numpy())
        q = order(qx, given.value, files.prefix)
        out = [(qid, *files.search(qid, x, o, k, factor, power)) for qid, x, o in zip(queries["vec_id"].tolist(), qx, q)]
        return pd.DataFrame({"query_id": np.repeat([o[0] for o in out], [len(o[1]) for o in out]), "vec_id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

    index = v.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = v.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    found = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(search, _FOUND)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
