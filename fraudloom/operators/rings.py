"""Strongly connected components, and rings of any length whose transfers lie within a stretch of time."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudloom.scratch import Scratch


def _trimmed(s: Scratch, p: DataFrame) -> DataFrame:
    """Edges that have one before and one after them, until that no longer changes; only such can be on a cycle."""
    n = p.count()
    while n:
        both = p.join(p.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(p.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select(*p.columns)
        nxt = s.table(both, "trim")
        s.drop(p)
        p, m, n = nxt, n, nxt.count()
        if m == n:
            break
    return p


def strong_components(e: DataFrame) -> DataFrame:
    """e (src, dst) -> (node, component) of every node: component is the largest node of its strongly connected component.

    Forward-backward search with colours: each node takes the largest node
    that reaches it as its colour; what of a colour can be reached backwards
    from the node that gave it is that node's component. These go, and the
    rest is done again. Edges between colours are on no cycle and go as well,
    as does all that trimming finds. Every step is a join and an aggregate
    with map-side combine over a written table; rounds follow the graph's
    diameter, not its size. Null ends and self-links are no edges.
    """
    s = Scratch(e.sparkSession, "scc")
    e = e.select("src", "dst").filter("src is not null and dst is not null")
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    left = _trimmed(s, s.table(e.filter("src <> dst").distinct(), "edges"))
    found = None
    while not left.isEmpty():
        colour = s.table(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().select("node", F.col("node").alias("colour")), "colour")
        while True:
            got = left.join(colour, left.src == colour.node).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("got"))
            nxt = s.table(colour.join(got, "node", "left").select("node", F.greatest("colour", F.coalesce("got", "colour")).alias("colour"), (F.coalesce("got", "colour") > F.col("colour")).alias("moved")), "colour")
            s.drop(colour)
            moved, colour = nxt.filter("moved").limit(1).count(), nxt.drop("moved")
            if not moved:
                break
        inside = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("colour"))
        inside = s.table(inside, "inside")
        front = s.table(colour.filter("node = colour"), "front")
        members = front
        for k in count(1):
            back = inside.join(front, (inside.dst == front.node) & (inside.colour == front.colour)).select(F.col("src").alias("node"), inside.colour).distinct()
            front = s.table(back.join(members.select("node"), "node", "left_anti").select("node", "colour"), "front")
            if front.isEmpty():
                break
            members = members.unionByName(front)
            if k % 16 == 0:
                members = s.table(members, "members")
        members = s.table(members, "members")
        found = members if found is None else found.unionByName(members)
        rest = inside.select("src", "dst").join(members.select(F.col("node").alias("src")), "src", "left_anti").join(members.select(F.col("node").alias("dst")), "dst", "left_anti")
        left = _trimmed(s, s.table(rest.select("src", "dst"), "edges"))
    if found is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("colour", "node").alias("component"))


def rings_within(e: DataFrame, span_us: int) -> DataFrame:
    """e (src, dst, time) -> (ring, members, length): every time-ordered ring, of any length, whose transfers lie within `span_us` of each other.

    A ring is an elementary cycle of two nodes or more with a rotation whose
    times don't decrease; of parallel transfers the last counts. Only edges
    inside a strongly connected component are looked at. A ring is grown from
    its first transfer in the order of time, so a path never has to fall; if
    all its transfers are of one moment, from the first by its ends. It grows only over transfers that lie in the same or the
    next stretch of time: what a path can meet is bounded by the transfers of
    `span_us`, not by a length or by the size of a hub over all time.
    """
    s = Scratch(e.sparkSession, "rings")
    p = e.filter("src <> dst").groupBy("src", "dst").agg(F.max("time").cast("long").alias("t")).filter("t is not null")
    comp = strong_components(p)
    p = p.join(comp.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(comp.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst").filter("a = b")
    p = s.table(p.select("src", "dst", "t", F.floor(F.col("t") / F.lit(span_us + 1)).alias("bin")), "core")
    first = F.struct(F.col("t"), F.col("src"), F.col("dst"))
    path = s.table(p.select(first.alias("first"), F.array("src", "dst").alias("nodes"), F.col("t").alias("last"), F.col("src").alias("head"), F.col("dst").alias("tail"), F.col("bin").alias("at"), F.lit(True).alias("least")), "path")
    step = p.select(F.col("src").alias("tail"), F.col("dst").alias("nxt"), "t", "bin")
    found = None
    while True:
        both = path.withColumn("bin", F.explode(F.array("at", F.col("at") + 1)))
        fits = (F.col("t") >= F.col("last")) & (F.col("t") - F.col("first.t") <= span_us)
        later = F.col("least") & (F.struct(F.col("t"), F.col("tail").alias("src"), F.col("nxt").alias("dst")) > F.col("first"))
        grown = both.join(step, ["tail", "bin"]).filter(fits & ((F.col("nxt") == F.col("head")) | ~F.array_contains("nodes", F.col("nxt"))))
        grown = s.table(grown.withColumn("least", later), "grown")
        closed = grown.filter("nxt = head and (t > first.t or least)").select("nodes")
        found = closed if found is None else found.unionByName(closed)
        more = grown.filter("nxt <> head").select("first", F.concat("nodes", F.array("nxt")).alias("nodes"), F.col("t").alias("last"), "head", F.col("nxt").alias("tail"), "at", "least")
        s.drop(path)
        path = s.table(more, "path")
        if path.isEmpty():
            break
    low = F.array_min("nodes")
    turn = F.array_position("nodes", low)
    ring = F.concat(F.slice("nodes", turn.cast("int"), F.size("nodes")), F.slice("nodes", F.lit(1), (turn - 1).cast("int")))
    return found.select(F.array_join(ring, ">").alias("ring"), F.array_sort("nodes").alias("members"), F.size("nodes").alias("length"))
