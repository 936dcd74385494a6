"""Transfer graphs: edges, degrees, entity resolution, distance, PageRank, motifs, communities, mules."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudloom.functions import scalars as S
from fraudloom.operators.components import connected_components
from fraudloom.operators.modularity import by_component
from fraudloom.operators.ranges import number
from fraudloom.scratch import Scratch

STRONG_KINDS = ("device", "email", "phone", "ip", "national_id", "account")
MERGE = 16


def aggregate_edges(e: DataFrame) -> DataFrame:
    """Ordered pairs with count, total and last time."""
    return e.groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("amount_minor").alias("total_minor"), F.max("time").alias("last_seen"))


def degrees(e: DataFrame) -> DataFrame:
    """Distinct counterparties in and out of each node."""
    p = e.select("src", "dst").distinct()
    o = p.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    i = p.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    return o.join(i, "node", "full").select("node", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def graph_counts(e: DataFrame) -> DataFrame:
    nodes = e.select(F.col("src").alias("n")).union(e.select("dst")).distinct()
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(e.select("src", "dst").distinct().agg(F.count("*").alias("n_edges")))  # one row each


def resolve_entities(records: DataFrame, strong: tuple[str, ...] = STRONG_KINDS) -> DataFrame:
    """records (id, identifiers array<struct<kind,value>>) -> (id, cluster): ids that share a strong identifier, directly or over others.

    Blank values join nothing, singletons stay. A shared value gives a star to
    its smallest id, never all pairs.
    """
    s = Scratch(records.sparkSession, "er")
    x = records.select("id", F.explode("identifiers").alias("x")).filter(F.col("x.kind").isin(*strong)).select("id", F.col("x.kind").alias("kind"), S.identifier(F.col("x.kind"), F.col("x.value")).alias("value"))
    x = x.filter(F.trim("value") != "")
    low = x.groupBy("kind", "value").agg(F.min("id").alias("low"))
    comp = connected_components(s, x.join(low, ["kind", "value"]).select(F.col("id").alias("u"), F.col("low").alias("v")))
    ids = records.select("id").distinct()
    return ids.join(comp, ids.id == comp.node, "left").select("id", F.coalesce("root", "id").alias("cluster"))


def components(e: DataFrame) -> DataFrame:
    """(node, component) of the weak components, self-loops included."""
    s = Scratch(e.sparkSession, "wcc")
    comp = connected_components(s, e.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    nodes = e.select(F.col("src").alias("n")).union(e.select("dst")).distinct()
    return nodes.join(comp, nodes.n == comp.node, "left").select(F.col("n").alias("node"), F.coalesce("root", "n").alias("component"))


def distance_to_bad(e: DataFrame, bad: DataFrame) -> DataFrame:
    """(node, dist): undirected hops to the nearest bad node of the graph, 0 for those, -1 if none is reachable.

    Level-synchronous search; each level is a written table, visited nodes are
    taken out by an anti-join, and it ends with the first empty level. The
    visited ones are written anew every MERGE levels, so plans stay short.
    """
    s = Scratch(e.sparkSession, "bfs")
    und = s.table(e.select("src", "dst").union(e.select("dst", "src")).filter("src <> dst").distinct(), "edges")
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    front = s.table(nodes.join(bad.select(F.col("node")).distinct(), "node", "left_semi").select("node", F.lit(0).cast("long").alias("dist")), "seen")
    seen = front
    for hop in count(1):
        nxt = front.join(und, front.node == und.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").select("node", F.lit(hop).cast("long").alias("dist"))
        front = s.table(nxt, "level")
        if front.isEmpty():
            break
        seen = seen.union(front)
        if hop % MERGE == 0:
            seen = s.table(seen, "seen")
    return nodes.join(seen, "node", "left").select("node", F.coalesce("dist", F.lit(-1)).cast("long").alias("dist"))


def pagerank(e: DataFrame, weight: Column, order: str, personal: DataFrame | None = None, directed: bool = True, rounds: int = 100, alpha: float = 0.85, tolerance: float | None = 1e-6) -> DataFrame:
    """(node, rank): power iteration over weighted edges, of repeated pairs the last by `order` counting.

    Dangling mass goes by the teleport vector: uniform, or uniform over the
    nodes in `personal` (all ranks 0 if none is in the graph). It stops when
    the L1 change is below n * tolerance and raises if `rounds` don't get
    there; without tolerance it takes exactly `rounds`. Only two numbers a
    round (dangling mass and change) come to the driver.
    """
    s = Scratch(e.sparkSession, "pr")
    return _ranks(s, s.table(_last(e, weight, order), "last"), personal, directed, rounds, alpha, tolerance)


def _last(e: DataFrame, weight: Column, order: str) -> DataFrame:
    return e.groupBy("src", "dst").agg(F.max_by(weight, order).cast("double").alias("w"))


def _ranks(s: Scratch, last: DataFrame, personal: DataFrame | None, directed: bool, rounds: int, alpha: float, tolerance: float | None) -> DataFrame:
    """pagerank() of pairs (src, dst, w), each there once, in a written table."""
    nodes = last.select(F.col("src").alias("node")).union(last.select("dst")).distinct()
    if not directed:
        last = last.select("src", "dst", "w").union(last.filter("src <> dst").select("dst", "src", "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))
    total = last.groupBy("src").agg(F.sum("w").alias("t"))
    share = s.table(last.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p")), "share")
    if personal is not None:
        hit = nodes.join(personal.select("node").distinct(), "node", "left_semi").withColumn("hit", F.lit(1.0))
        nodes = nodes.join(hit, "node", "left").withColumn("hit", F.coalesce("hit", F.lit(0.0)))
    else:
        nodes = nodes.withColumn("hit", F.lit(1.0))
    dangling = nodes.join(total.select(F.col("src").alias("node")).withColumn("out", F.lit(True)), "node", "left")
    nodes = s.table(dangling.select("node", "hit", F.col("out").isNull().alias("dangling")), "nodes")
    n, hits = nodes.agg(F.count("*"), F.sum("hit")).first()
    if not n or not hits:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    cur, held = nodes.select("node", (F.col("hit") / hits if personal is not None else F.lit(1.0 / n)).alias("rank"), "hit", "dangling"), None
    for _ in range(rounds):
        lost = cur.filter("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        into = cur.join(share, cur.node == share.src).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        nxt = nodes.join(into, "node", "left").join(cur.select("node", F.col("rank").alias("was")), "node")
        nxt = nxt.select("node", (alpha * (F.coalesce("got", F.lit(0.0)) + lost * F.col("hit") / hits) + (1 - alpha) * F.col("hit") / hits).alias("rank"), "hit", "dangling", "was")
        nxt = s.table(nxt, "rank")
        done = tolerance is not None and nxt.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] < n * tolerance
        if held is not None:
            s.drop(held)  # the round before: nothing reads it any more
        cur, held = nxt.drop("was"), nxt
        if done:
            break
    else:
        if tolerance is not None:
            raise RuntimeError(f"ranks did not converge in {rounds} rounds")
    return cur.select("node", "rank")


def hubs(e: DataFrame, least: int = 3) -> DataFrame:
    """Nodes paid by `least` or more others that pay somebody: (node, n_sources, members)."""
    p = e.select("src", "dst").distinct()
    i = p.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_sources"), F.sort_array(F.collect_list("src")).alias("sources")).filter(F.col("n_sources") >= least)
    return i.join(p.select(F.col("src").alias("node")).distinct(), "node", "left_semi").select("node", "n_sources", F.concat(F.array("node"), "sources").alias("members"))


def hub_members(e: DataFrame, least: int = 3) -> DataFrame:
    """(node, member): the payers of each hub, a row each, so a hub of any size is rows and not one array."""
    p = e.select("src", "dst").distinct()
    wide = p.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("c")).filter(F.col("c") >= least).select("node").join(p.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    return p.withColumnRenamed("dst", "node").join(wide, "node", "left_semi").select("node", F.col("src").alias("member"))


def scatter_gather(e: DataFrame, least: int = 3) -> DataFrame:
    """(src, sink, n_mids): `least` or more middle nodes between two different nodes.

    Payers of fewer than `least` nodes and nodes paid by fewer can't be ends
    and go before the two sides meet; the join over a busy middle node is one
    that AQE may split, and pairs are counted before they are shuffled.
    """
    p = e.select("src", "dst").distinct()
    wide = p.groupBy("src").agg(F.count("*").alias("c")).filter(F.col("c") >= least).select("src")
    deep = p.groupBy("dst").agg(F.count("*").alias("c")).filter(F.col("c") >= least).select("dst")
    a = p.join(wide, "src", "left_semi").select("src", F.col("dst").alias("mid"))
    b = p.join(deep, "dst", "left_semi").select(F.col("src").alias("mid"), F.col("dst").alias("sink"))
    return a.join(b, "mid").filter("src <> sink").groupBy("src", "sink").agg(F.count("*").alias("n_mids")).filter(F.col("n_mids") >= least)


def temporal_rings(e: DataFrame, max_len: int | None = None) -> DataFrame:
    """Elementary cycles of 2 nodes or more (to max_len, if given) with a rotation whose times don't decrease: (ring, members, length).

    Paths grow from the cycle's smallest node only, so each cycle is found
    once, until none is left. Parallel edges keep their last time. Dead ends
    are peeled off first: an edge that no cycle can use doesn't join. A
    rotation is non-decreasing exactly if the cyclic sequence of times falls
    at most once, so a path that fell stays at or under its first time.
    """
    s = Scratch(e.sparkSession, "rings")
    p = s.table(e.filter("src <> dst").groupBy("src", "dst").agg(F.max("time").alias("t")), "pairs")
    for _ in range(3):
        p = p.join(p.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(p.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", "t")
    p = s.table(p, "core")
    path = s.table(p.filter("src < dst").select(F.col("src").alias("head"), F.array("src", "dst").alias("nodes"), F.col("t").alias("first"), F.col("t").alias("last"), F.lit(False).alias("fell"), F.col("dst").alias("tail")), "path")
    fell = F.col("fell") | (F.col("t") < F.col("last"))
    fits = ~(F.col("fell") & (F.col("t") < F.col("last"))) & (~fell | (F.col("t") <= F.col("first")))
    found = None
    for k in count(2):
        # The last edge may fall back to the first one's time only if nothing fell before, which is what `fits` says.
        close = path.join(p, (path["tail"] == p["src"]) & (path["head"] == p["dst"])).filter(fits).select("nodes")
        found = close if found is None else found.unionByName(close)
        if k == max_len:
            break
        grown = path.join(p, path["tail"] == p["src"]).filter((F.col("dst") > F.col("head")) & ~F.array_contains("nodes", F.col("dst")) & fits)
        path = s.table(grown.select("head", F.concat("nodes", F.array("dst")).alias("nodes"), "first", F.col("t").alias("last"), fell.alias("fell"), F.col("dst").alias("tail")), "path")
        if path.isEmpty():
            break
    return found.select(F.array_join("nodes", ">").alias("ring"), F.array_sort("nodes").alias("members"), F.size("nodes").alias("length"))


def mule_scores(a: DataFrame) -> DataFrame:
    """a (account, fan_in, fan_out, inflow_minor, outflow_minor, dwell_secs, dormant_days) -> mule_score, signals, alert."""
    fan = (F.col("fan_in") >= 5) & F.col("fan_out").between(1, 2)
    ratio = F.try_divide(F.col("outflow_minor").cast("double"), F.col("inflow_minor").cast("double"))
    through = (F.col("inflow_minor") > 0) & F.coalesce(F.abs(ratio - 1) <= 0.1, F.lit(False))
    dwell = (F.col("outflow_minor") > 0) & (F.col("dwell_secs") <= 3_600)
    woke = (F.col("dormant_days") >= 30) & (F.col("inflow_minor") > 0)
    signals = [(fan, 0.4, "fan_in_fan_out"), (through, 0.3, "pass_through"), (dwell, 0.2, "short_dwell"), (woke, 0.3, "dormant_then_active")]
    score = F.lit(0.0)
    for on, w, _ in signals:
        score = score + F.when(on, w).otherwise(0.0)
    d = a.withColumn("mule_score", F.least(F.lit(1.0), score)).withColumn("signals", F.array_compact(F.array(*[F.when(on, F.lit(n)) for on, _, n in signals])))
    return d.withColumn("alert", F.col("mule_score") >= 0.5)


def account_activity(e: DataFrame) -> DataFrame:
    """Mule inputs from transfers: distinct payers and payees, flows, seconds from the first credit to the last debit, days since the start of the table."""
    i = e.groupBy(F.col("dst").alias("account")).agg(F.count_distinct("src").alias("fan_in"), F.sum("amount_minor").alias("inflow_minor"), F.min("time").alias("first_in"))
    o = e.groupBy(F.col("src").alias("account")).agg(F.count_distinct("dst").alias("fan_out"), F.sum("amount_minor").alias("outflow_minor"), F.max("time").alias("last_out"), F.min("time").alias("first_out"))
    start = e.agg(F.min("time").alias("start"))
    j = i.join(o, "account", "full").crossJoin(F.broadcast(start))  # one row
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select("account", z("fan_in"), z("fan_out"), z("inflow_minor"), z("outflow_minor"), F.coalesce(F.floor((F.col("last_out") - F.col("first_in")) / 1_000_000), F.lit(0)).alias("dwell_secs"),
                    F.floor((F.least("first_in", "first_out") - F.col("start")) / 86_400_000_000).alias("dormant_days"))


def _numbered(s: Scratch, pairs: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (src, dst and `more`) in a written table -> (node, id), 1, 2, 3 ... in the order of the names; the pairs with numbers for names. Null has none."""
    names = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).filter("node is not null").distinct()
    nodes = s.table(number(names, "node", "id"), "nodes")
    end = lambda c: nodes.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
    return nodes, s.table(pairs.join(end("src"), "src", "left").join(end("dst"), "dst", "left").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), *more), "links")


def communities(e: DataFrame) -> DataFrame:
    """(node, component, community, community_size): greedy modularity of the whole graph; communities numbered by size, ties by their smallest node.

    Merges join neighbours only, so weak components are merged apart, with
    the link count of the whole graph. One merge follows the other, so a
    component is one task's work: its pairs pass in as numbers in the order of
    the names, 8 bytes each. label_propagation() is the distributed approximation.
    """
    s = Scratch(e.sparkSession, "communities")
    nodes, links = _numbered(s, s.table(e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "pairs"))
    name = lambda c: nodes.select(F.col("id").alias(c), F.col("node").alias(f"{c}_name"))
    found = _communities(s, links).join(name("node"), "node").join(name("component"), "component")
    return found.select(F.col("node_name").alias("node"), F.col("component_name").alias("component"), "community", "community_size")


def _communities(s: Scratch, links: DataFrame) -> DataFrame:
    """communities() of numbered pairs, where node and component are numbers."""
    pairs = s.table(links.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct(), "pairs")
    m = pairs.count()
    pairs = pairs.filter("u is not null")  # else neither end has a name
    comp = connected_components(s, pairs).withColumnRenamed("node", "u")
    rows = pairs.join(comp, "u", "left").select(F.coalesce("root", "u").alias("component"), F.col("u").alias("a"), F.col("v").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, *found in by_component(batches, m):
            for k in range(0, len(found[0]), 100_000):
                ids, first, size = (x[k : k + 100_000] for x in found)
                yield pa.RecordBatch.from_pydict({"node": ids.astype(np.int64), "component": np.full(len(ids), c), "first": first.astype(np.int64), "community_size": size.astype(np.int64)})

    found = s.table(rows.repartition("component").sortWithinPartitions("component").mapInArrow(run, "node long, component long, first long, community_size long"), "found")
    firsts = number(found.filter("node = first").select("first", "community_size"), [F.desc("community_size"), F.col("first")], "community").select("first", (F.col("community") - 1).alias("community"))
    return found.join(firsts, "first").select("node", "component", "community", "community_size")


def label_propagation(e: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label): every node takes the most frequent label around it, ties to the smallest; an approximation that scales out."""
    s = Scratch(e.sparkSession, "lpa")
    und = s.table(e.select("src", "dst").union(e.select("dst", "src")).filter("src <> dst").distinct(), "edges")
    cur = s.table(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("label", F.col("node")), "labels")
    for _ in range(rounds):
        votes = und.join(cur, und.src == cur.node).groupBy(F.col("dst").alias("node"), "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("node").agg(F.min(F.struct(-F.col("n"), F.col("label").alias("label")))["label"].alias("new"))
        cur = s.table(cur.join(best, "node", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")
    return cur


def feature_rows(e: DataFrame, bad: DataFrame, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """The five graph features of a node.

    Transfers are read once: all five come from pairs of numbers, each there
    once, and names return at the end. Communities come first, while the
    executors hold little beside their merging task.
    """
    s = Scratch(e.sparkSession, "features")
    nodes, links = _numbered(s, s.table(_last(e, F.col("amount_minor"), "seq"), "last"), "w")
    wrong = s.table(nodes.join(bad.select("node").distinct(), "node", "left_semi").select(F.col("id").alias("node")), "bad")
    groups = s.table(_communities(s, links).select("node", "community", "community_size"), "communities")
    dist = s.table(distance_to_bad(links, wrong).withColumnRenamed("dist", "dist_to_bad"), "dist")
    pr = _ranks(s, links, None, True, rounds, 0.85, tolerance).withColumnRenamed("rank", "pagerank")
    pp = _ranks(s, links, wrong, False, rounds, 0.85, tolerance).withColumnRenamed("rank", "ppr_bad")
    ranks = pr.join(pp, "node").join(groups, "node").join(dist, "node").withColumnRenamed("node", "id")
    return ranks.join(nodes, "id").select("node", "pagerank", "ppr_bad", "community", "community_size", "dist_to_bad")


def bad_nodes(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")
