"""Jaro-Winkler join of two lists of names without scoring all pairs.

Listed names stand by length, sorted, as an implicit trie: a node is the range
of names with a common prefix. A name walks down and keeps the best score that
anything below can still have: characters of the prefix that find no partner
within reach are lost, and a prefix that differs early earns no boost. Ranges
that can't reach the threshold are cut whole. The lengths alone decide which
tries a name walks at all; each trie is a unit of a size that is fixed, so
neither list has to fit anywhere.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudloom.functions.udfs import jaro_winkler

#: Listed names in one trie.
UNIT = 50_000
#: Tasks that share the names that ask one trie.
SPREAD = 4
#: The boost: a tenth for each equal character at the start, four at most, on similarities above 0.7.
BOOST, BOOSTED, LEAST = 0.1, 4, 0.7
_SLACK = 1e-9


def best_score(matched: int, a: int, b: int, prefix: int) -> float:
    """What two names of lengths a and b score at most with so many matched characters and such a common prefix."""
    if not matched:
        return 0.0
    jaro = (matched / a + matched / b + 1) / 3
    return jaro + BOOST * prefix * (1 - jaro) if jaro > LEAST else jaro


def length_ratio(threshold: float) -> float:
    """The least ratio of lengths at which the threshold can be reached: Jaro is at most (2 + ratio) / 3, boosted."""
    return 3 * (threshold - BOOST * BOOSTED) / (1 - BOOST * BOOSTED) - 2


class NameTrie:
    """Distinct names of one length."""

    def __init__(self, names: list[str]):
        self.names = sorted(names)
        self.size = len(self.names[0]) if names else 0
        self.bags = [Counter(n) for n in self.names]

    def search(self, a: str, threshold: float) -> tuple[list[tuple[str, float]], int]:
        """(names that reach the threshold with their scores, names scored)."""
        names, n, la = self.names, self.size, len(a)
        if not names:
            return [], 0
        if not n or not la:
            return ([(a, 1.0)], 1) if n == la else ([], 0)
        reach, have, out, scored = max(la, n) // 2 - 1, Counter(a), [], 0
        at = bisect_left(names, a)
        if at < len(names) and names[at] == a:  # equal names score 1, also those too short to have a reach
            out, scored = [(a, 1.0)], 1
        # (first, end, depth, characters without a partner, equal characters at the start, what is left of a's characters)
        stack = [(0, len(names), 0, 0, 0, have)]
        while stack:
            lo, hi, d, lost, same, left = stack.pop()
            if hi - lo <= 2 or d == n:
                for k in range(lo, hi):
                    if names[k] == a:
                        continue
                    common = sum(min(v, have[c]) for c, v in self.bags[k].items() if c in have)
                    start = next((i for i in range(min(BOOSTED, n, la)) if a[i] != names[k][i]), min(BOOSTED, n, la))
                    if best_score(min(common, n - lost), la, n, start) >= threshold - _SLACK:
                        scored += 1
                        s = jaro_winkler(a, names[k])
                        if s >= threshold:
                            out.append((names[k], s))
                continue
            k = lo
            while k < hi:
                head = names[k][: d + 1]
                c = head[d]
                end = bisect_left(names, names[k][:d] + chr(ord(c) + 1), k, hi) if ord(c) < 0x10FFFF else hi
                if left[c] > 0 and c in a[max(0, d - reach) : d + reach + 1]:
                    less, gone = left.copy(), lost
                    less[c] -= 1
                else:
                    less, gone = left, lost + 1
                equal = same + (same == d and d < BOOSTED and d < la and a[d] == c)
                boost = BOOSTED if equal == d + 1 and equal < BOOSTED else equal
                if best_score(min(n - gone, la), la, n, min(boost, la, n)) >= threshold - _SLACK:
                    stack.append((k, end, d + 1, gone, equal, less))
                k = end
        return out, scored


def _walk(threshold: float):
    """Rows (unit, side, name) in order, a unit's listed names (side 0) before those looked up -> (a, b, name_score, scored); a row with null b says how many were scored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, listed, trie = None, [], None
        for batch in batches:
            a, b, score, scored = [], [], [], []
            for u, side, name in zip(*(batch.column(c).to_pylist() for c in ("unit", "side", "name"))):
                if u != unit:
                    unit, listed, trie = u, [], None
                if side == 0:
                    listed.append(name)
                    continue
                if trie is None:
                    trie = NameTrie(listed)
                hits, n = trie.search(name, threshold)
                for x, s in [*hits, (None, None)]:
                    a.append(name)
                    b.append(x)
                    score.append(s)
                    scored.append(n if x is None else None)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(score, pa.float64()), pa.array(scored, pa.int64())], ["a", "b", "name_score", "scored"])

    return run


def _searched(names: DataFrame, listed: DataFrame, threshold: float, unit: int) -> DataFrame:
    n, w = (d.select(F.col(d.columns[0]).cast("string").alias("name")).filter("name is not null").distinct().withColumn("len", F.length("name")) for d in (names, listed))
    units = w.groupBy("len").agg(F.count("*").alias("n")).select("len", F.expr(f"cast(ceil(n / {float(unit)}D) as int)").alias("blocks"))
    r = length_ratio(threshold)
    if r > 0.05:
        spans = F.sequence(F.ceil(F.col("len") * r - _SLACK), F.floor(F.col("len") / r + _SLACK))
        asked = n.select("name", F.explode(spans).alias("len"))
    else:  # a threshold that lengths say nothing about
        asked = n.select("name").crossJoin(F.broadcast(w.agg(F.max("len").alias("top")))).select("name", F.explode(F.sequence(F.lit(0), F.coalesce("top", F.lit(0)))).alias("len"))  # one row
    at = lambda b: F.concat_ws(":", "len", b)
    left = w.join(units, "len").select(at(F.pmod(F.xxhash64("name"), F.col("blocks"))).alias("unit"), F.lit(0).alias("side"), "name")
    right = asked.join(units, "len").select("len", "name", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    # Names looked up are dealt further, so that a unit that many ask is many tasks' work; each of them builds its trie.
    many = right.select(at("b").alias("unit"), "name", F.pmod(F.xxhash64("name"), F.lit(SPREAD)).cast("int").alias("part"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    both = left.select("unit", "part", "side", "name").unionByName(many.select("unit", "part", F.lit(1).alias("side"), "name"))
    d = both.repartition("unit", "part").sortWithinPartitions("unit", "part", "side", "name").select(F.concat_ws("/", "unit", "part").alias("unit"), "side", "name")
    return d.mapInArrow(_walk(threshold), "a string, b string, name_score double, scored long")


def similar_names(names: DataFrame, listed: DataFrame, threshold: float, unit: int = UNIT) -> DataFrame:
    """First columns of both -> (a, b, name_score): every pair of distinct names that scores the threshold or more, once.

    Loses nothing; equal names score 1, also empty ones; null names match nothing.
    """
    return _searched(names, listed, threshold, unit).filter("b is not null").select("a", "b", "name_score")


def work(names: DataFrame, listed: DataFrame, threshold: float, unit: int = UNIT) -> DataFrame:
    """One row: names, listed, scored (pairs that were scored at all), share of all pairs."""
    count = lambda d: d.select(d.columns[0]).distinct().filter(F.col(d.columns[0]).isNotNull()).agg(F.count("*").alias("n"))
    one = _searched(names, listed, threshold, unit).agg(F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"))
    d = one.crossJoin(count(names).withColumnRenamed("n", "names")).crossJoin(count(listed).withColumnRenamed("n", "listed"))  # one row each
    return d.select("names", "listed", "scored", F.try_divide(F.col("scored").cast("double"), F.col("names").cast("double") * F.col("listed")).alias("share"))
