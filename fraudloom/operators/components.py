"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudloom.scratch import Scratch


def connected_components(scratch: Scratch, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u, v: any ordered type, any order, no nulls) -> (node, root), root the smallest node reachable.

    Every step is a min aggregate (combined map-side) and an equi-join that
    AQE may split, so a hub never gathers in one task. Each round is a written
    table; it ends when the edges no longer change. Nodes without an edge to
    another node don't appear.
    """
    def norm(e: DataFrame) -> DataFrame:
        return e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    cur = scratch.table(norm(edges), "edges")
    seen = sign(cur)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = norm(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m2.select("u", F.col("m").alias("v")))
        nxt = scratch.table(norm(small), "edges")
        now = sign(nxt)
        scratch.drop(cur)
        cur, same, seen = nxt, now == seen, now
        if same:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def contracted(scratch: Scratch, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges as above, many and in any number -> (node, label) of the nodes with a smaller neighbour, the smallest one; and the edges between labels.

    The smallest node of a component is a label (its own), so components of
    those edges are the components of all. One aggregate and two joins with
    the labels; edges between labels are few where nodes have many edges, and
    they are made distinct before they move.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = scratch.table(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")), "labels")
    end = lambda c: low.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")).hint("shuffle_hash")
    rest = e.join(end("u"), "u").join(end("v"), "v", "left").select(F.col("lu").alias("u"), F.coalesce("lv", "v").alias("v"))
    return low, scratch.table(rest.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "between")
