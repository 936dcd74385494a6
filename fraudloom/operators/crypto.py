"""On-chain analytics: CoinJoin detection, address clusters, FIFO taint, peel chains, sanctions, poisoning, travel rule."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudloom.functions import scalars as S
from fraudloom.operators.components import connected_components, contracted
from fraudloom.scratch import Scratch

PEEL_RATIO, PEEL_HOPS, PEEL_BONUS = 0.8, 3, 0.25
POISON_SECS = 86_400
TRAVEL_RULE_MINOR = 100_000


def output_value(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("output_minor", F.aggregate("outputs", F.lit(0).cast("long"), lambda a, o: a + o["value"]))


def coinjoins(ledger: DataFrame, inputs: int = 3, equal: int = 3) -> DataFrame:
    """Adds coinjoin: a given flag wins; else enough inputs and enough equal output values."""
    values = F.transform("outputs", lambda o: o["value"])
    top = F.coalesce(F.array_max(F.transform(F.array_distinct(values), lambda v: F.size(F.filter(values, lambda x: x == v)))), F.lit(0))
    guess = (F.size("inputs") >= inputs) & (top >= equal)
    given = F.col("coinjoin") if "coinjoin" in ledger.columns else F.lit(None).cast("boolean")
    return ledger.withColumn("coinjoin", F.coalesce(given, guess))


def address_clusters(ledger: DataFrame) -> DataFrame:
    """(address, cluster): inputs of one transaction that is no CoinJoin belong together; outputs alone stay singletons."""
    s = Scratch(ledger.sparkSession, "clusters")
    tx = s.table(coinjoins(ledger).select("inputs", F.transform("outputs", lambda o: o["address"]).alias("paid"), "coinjoin"), "transactions")
    star = tx.filter(~F.col("coinjoin")).select(F.element_at("inputs", 1).alias("v"), F.explode("inputs").alias("u")).filter("u is not null and v is not null")
    labels, rest = contracted(s, star)
    comp = connected_components(s, rest).withColumnRenamed("node", "label")
    every = tx.select(F.explode(F.concat(F.coalesce("inputs", F.array()), F.coalesce("paid", F.array()))).alias("address")).filter("address is not null").distinct()
    of = every.join(labels.withColumnRenamed("node", "address"), "address", "left").select("address", F.coalesce("label", "address").alias("label"))
    return of.join(comp, "label", "left").select("address", F.coalesce("root", "label").alias("cluster"))


def same_cluster(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) -> same; an address that was never seen is in no cluster."""
    clusters = Scratch(clusters.sparkSession, "same").table(clusters, "clusters")  # read for each side
    x = clusters.select(F.col("address").alias("a"), F.col("cluster").alias("ca"))
    y = clusters.select(F.col("address").alias("b"), F.col("cluster").alias("cb"))
    return pairs.join(x, "a", "left").join(y, "b", "left").select("a", "b", F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).alias("same"))


class Lots:
    """What an address holds, oldest first: values and taints of 8 bytes each, with running totals.

    Lots next to each other that are all clean, or tainted to their last unit,
    are one: however they are spent, each unit's taint is the same.
    """

    __slots__ = ("v", "t", "head", "held", "tainted")
    FULL, TRIM = 2**62, 4_096

    def __init__(self):
        self.v, self.t, self.head, self.held, self.tainted = array("q"), array("q"), 0, 0, 0

    def add(self, value: int, taint: int) -> None:
        self.held += value
        self.tainted += taint
        if len(self.v) > self.head and value > 0 and 0 < self.v[-1] < self.FULL - value and (taint == self.t[-1] == 0 or (taint == value and self.t[-1] == self.v[-1])):
            self.v[-1] += value
            self.t[-1] += taint
        else:
            self.v.append(value)
            self.t.append(taint)

    def spend(self, need: int) -> int:
        """The taint of the oldest `need` units, or of all if there are fewer."""
        sent = 0
        while need > 0 and self.head < len(self.v):
            v, t = self.v[self.head], self.t[self.head]
            whole = v <= need
            part, used = (t, v) if whole else (t * need // v, need)
            if whole:
                self.head += 1
            else:
                self.v[self.head], self.t[self.head] = v - need, t - part
            sent, need = sent + part, need - used
            self.held -= used
            self.tainted -= part
        if self.head > self.TRIM and 2 * self.head > len(self.v):
            del self.v[: self.head], self.t[: self.head]
            self.head = 0
        return sent


def trace(rows: Iterable[tuple[str, str, int]], bad: set[str]) -> dict[str, list]:
    """FIFO over transfers in order -> address: [held, tainted, direct, indirect], taint in whole units.

    A bad sender emits fully tainted value and spends no lots. Others spend
    their oldest lots first, a split lot's taint is cut to whole units; what
    they don't hold comes in clean. The receiver gets one lot a transfer, with
    the taint of all that was spent for it. bad is asked row by row.
    """
    lots: dict[str, Lots] = {}
    flow: dict[str, list[int]] = {}
    for src, dst, value in rows:
        direct = indirect = 0
        if src in bad:
            direct = value
        else:
            if src not in lots:
                lots[src] = Lots()
            indirect = lots[src].spend(value)
        if dst not in lots:
            lots[dst] = Lots()
        lots[dst].add(value, direct + indirect)
        f = flow.setdefault(dst, [0, 0])
        f[0] += direct
        f[1] += indirect
    return {a: [q.held, q.tainted, *flow.get(a, [0, 0])] for a, q in lots.items()}


def taint(transfers: DataFrame, bad: DataFrame) -> DataFrame:
    """transfers (seq, src, dst, value) -> per address held, tainted, direct, indirect and tainted_fraction of what it holds.

    Order matters across addresses, so each weak component is replayed in seq
    order; components run in parallel, one is a task's work. The rows pass
    through that task in batches, sorted by Spark; it keeps the lots only.
    """
    from fraudloom.operators.graph import components

    comp = components(transfers).withColumnRenamed("node", "src")
    flagged = transfers.join(bad.select(F.col("node").alias("src")).distinct().withColumn("bad", F.lit(True)), "src", "left").join(comp, "src").select("component", "seq", "src", "dst", "value", F.coalesce("bad", F.lit(False)).alias("bad"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: set[str] = set()

        def rows(component: str, first: pd.DataFrame) -> Iterator[tuple[str, str, int]]:
            pdf = first
            while pdf is not None:
                mine = pdf[pdf.component == component]
                known.update(mine.src[mine.bad])
                yield from zip(mine.src, mine.dst, mine.value.astype(int).tolist())
                ahead[0] = pdf = pdf[len(mine):] if len(mine) < len(pdf) else next(parts, None)
                if pdf is not None and pdf.component.iloc[0] != component:
                    return

        ahead = [next(parts, None)]
        while ahead[0] is not None:
            if ahead[0].empty:
                ahead[0] = next(parts, None)
                continue
            got = trace(rows(ahead[0].component.iloc[0], ahead[0]), known)
            yield pd.DataFrame([(a, *v) for a, v in got.items()], columns=["address", "held", "tainted", "direct", "indirect"])

    t = flagged.repartition("component").sortWithinPartitions("component", "seq").mapInPandas(run, "address string, held long, tainted long, direct long, indirect long")
    return t.withColumn("tainted_fraction", F.when(F.col("held") > 0, F.try_divide(F.col("tainted").cast("double"), F.col("held").cast("double"))).otherwise(0.0))


def peel_chains(transfers: DataFrame, bad: DataFrame, ratio: float = PEEL_RATIO, hops: int = PEEL_HOPS) -> DataFrame:
    """(start, length): successors of bad nodes from which `hops` dominant transfers or more follow one another.

    A node's dominant transfer is its largest of two or more (ties to the
    last) with `ratio` of all it sends. A hop back to a node of the chain counts
    and ends it; its length needs no more than `hops` steps to decide.
    """
    big = transfers.groupBy("src").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max(F.struct("value", "seq", "dst")).alias("m")).filter("n >= 2")
    dom = big.filter(F.col("m.value") >= F.lit(ratio) * F.col("total")).select("src", F.col("m.dst").alias("nxt"))
    start = transfers.join(bad.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("start")).distinct()
    path = start.select("start", F.col("start").alias("at"), F.array("start").alias("seen"))
    for k in range(hops):
        path = path.join(dom, path["at"] == dom["src"])
        if k < hops - 1:  # a closed chain takes no further hop
            path = path.filter(~F.array_contains("seen", F.col("nxt")))
        path = path.select("start", F.col("nxt").alias("at"), F.concat("seen", F.array("nxt")).alias("seen"))
    return path.select("start", F.lit(hops).alias("length"))


def exposure(transfers: DataFrame, bad: DataFrame) -> DataFrame:
    """Adds peel and exposure_score: the tainted fraction, a quarter more if the graph has a peel chain, 1 at most."""
    t, peel = taint(transfers, bad), peel_chains(transfers, bad).agg((F.count("*") > 0).alias("peel"))
    return t.crossJoin(F.broadcast(peel)).withColumn("exposure_score", F.least(F.lit(1.0), F.col("tainted_fraction") + F.when(F.col("peel"), PEEL_BONUS).otherwise(0.0)))  # one row


def sanctioned(tx: DataFrame, entries: DataFrame) -> DataFrame:
    """tx (address, day, ...) that touched a listed address on its day: listed_day <= day < delisted_day, open if null."""
    e = entries.select("address", "listed_day", "delisted_day")
    on = (tx.address == e.address) & (e.listed_day <= tx.day) & (e.delisted_day.isNull() | (tx.day < e.delisted_day))
    return tx.join(e, on, "left_semi").withColumn("reason_code", F.lit("CRYPTO_SANCTIONS")).withColumn("disposition", F.lit("HARD_DECLINE"))


def poisoning(real: DataFrame, candidates: DataFrame, secs: int = POISON_SECS) -> DataFrame:
    """candidates (address, us) that look like an address of a real transfer (address, us) up to `secs` before: same ends, another middle.

    An equi-join on both ends and a time bin; the band is one bin wide.
    """
    wide = secs * 1_000_000
    ends = lambda d: d.filter(F.length("address") >= 4).withColumn("_h", F.left("address", F.lit(4))).withColumn("_t", F.right("address", F.lit(4)))
    r = ends(real).select("_h", "_t", F.col("address").alias("real"), F.col("us").alias("real_us"), F.explode(F.array(F.floor(F.col("us") / wide), F.floor(F.col("us") / wide) + 1)).alias("_b"))
    c = ends(candidates).withColumn("_b", F.floor(F.col("us") / wide))
    on = (r._h == c._h) & (r._t == c._t) & (r._b == c._b) & (r.real != c.address) & (c.us - r.real_us).between(0, wide)
    return c.join(r, on, "left_semi").drop("_h", "_t", "_b").withColumn("reason_code", F.lit("CRYPTO_ADDR_POISON")).withColumn("disposition", F.lit("SOFT"))


def travel_rule(tx: DataFrame, least: int = TRAVEL_RULE_MINOR) -> DataFrame:
    """Transfers between two providers at or over the threshold without originator data."""
    return tx.filter(F.col("from_vasp") & F.col("to_vasp") & (F.col("amount_minor") >= least) & ~F.col("has_originator_data")).withColumn("reason_code", F.lit("CRYPTO_TRAVEL_RULE")).withColumn("disposition", F.lit("SOFT"))
