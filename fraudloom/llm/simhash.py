"""SimHash near-duplicates (operator 4).

A text's fingerprint: words are maximal runs of anything but ASCII white space
after A-Z are lower-cased; each 3-word shingle (repeats included; the whole
sequence of a shorter text) is hashed with XXH64 (UTF-8, seed 42); a bit is set
if more than half of the hashes have it. Null and wordless texts: zero.

Candidates: two fingerprints within radius r agree on at least s - r of s
segments; every choice of s - r segments is a bucket key, so no pair is lost.
Inside a bucket fingerprints stand as 64 bit planes; distances of many pairs
are counted at once with carry-save counters that stop at r + 1, and a tile is
abandoned as soon as every pair in it is over the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, SEED, RADIUS, SEGMENTS, BLOCK = 3, 42, 2, 4, 4096
TILE = 256


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence if that is shorter; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    x = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([x(joined, seed)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size) + np.arange(n)
    start = end - size
    return np.array([x(joined[a:b], seed) for a, b in zip(start[: n - shingle + 1].tolist(), end[shingle - 1 :].tolist())], np.uint64)


def majority(h: np.ndarray) -> int:
    """The 64 bits that are set in more than half of the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        part = h[i : i + 8192]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def _add_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id long, fp long: the 64 bits), a row each."""
    common.prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_add_fingerprints, "doc_id long, fp long")


def planes(fp: np.ndarray) -> np.ndarray:
    """64 rows; bit k of row b is bit b of fingerprint k."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    pad = -len(fp) % 64
    return np.ascontiguousarray(np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1, bitorder="little")).view(np.uint64)


def near(query: np.ndarray, vertical: np.ndarray, skip: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Bit matrix (queries x columns, 64 columns a word) of the pairs within radius; skip marks pairs not to look at.

    Digits are the carry-save counters of the distances, lowest first. They
    start so far below their end that a pair's counter runs over exactly when
    its distance leaves the radius; `over` keeps that.
    """
    size = (radius + 1).bit_length() if (radius + 1) & radius else radius.bit_length()
    spare = (1 << size) - (radius + 1)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    digits = [np.full_like(skip, full) if spare >> k & 1 else np.zeros_like(skip) for k in range(size)]
    over = skip.copy()
    for b in range(64):
        q = np.where((query >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))
        carry = vertical[b][None, :] ^ q[:, None]
        for k, d in enumerate(digits):
            digits[k], carry = d ^ carry, d & carry
        over |= carry
        if b & 7 == 7 and (over == full).all():
            break
    return ~over


def pairs(fp: np.ndarray, group: np.ndarray, side: np.ndarray, same: np.ndarray, radius: int = RADIUS, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j within the radius, of one group; in a pair of different blocks only across its sides; with roots only of different ones."""
    n = len(fp)
    vertical = planes(fp)
    left, right = [], []
    cols = np.arange(vertical.shape[1] * 64)
    for a in range(0, n, TILE):
        i = np.arange(a, min(n, a + TILE))
        word0 = a // 64
        c = cols[word0 * 64 :]
        ok = (c[None, :] > i[:, None]) & (c < n)[None, :]
        cc = np.minimum(c, n - 1)
        ok &= group[cc][None, :] == group[i][:, None]
        ok &= same[i][:, None] | (side[cc][None, :] != side[i][:, None])
        if root is not None:
            ok &= root[cc][None, :] != root[i][:, None]
        if not ok.any():
            continue
        skip = ~np.ascontiguousarray(np.packbits(ok, axis=1, bitorder="little")).view(np.uint64)
        hit = near(fp[i], vertical[:, word0:], skip, radius)
        if hit.any():
            r, k = np.nonzero(np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little"))
            left.append(i[r])
            right.append(c[k])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs: as many links as needed, never all of a group."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := top.get(x, x)) != x:
            top[x] = top.get(p, p)
            x = p
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            top[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def link(radius: int = RADIUS):
    """Rows sorted by (key, bi, bj), with or without root -> links (u, v): whole units of work are compared together, in runs of about TILE rows or one unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}

        def edges(x: dict) -> np.ndarray:
            return np.flatnonzero((np.diff(x["key"]) != 0) | (np.diff(x["bi"]) != 0) | (np.diff(x["bj"]) != 0)) + 1

        def solve(x: dict) -> pa.RecordBatch:
            unit = np.zeros(len(x["key"]), np.int64)
            unit[edges(x)] = 1
            i, j = pairs(x["fp"].view(np.uint64), np.cumsum(unit), x["side"], x["bi"] == x["bj"], radius, x.get("root"))
            e = np.array(forest(i, j), np.int64).reshape(-1, 2)
            end = x["root"] if "root" in x else x["node"]
            return pa.RecordBatch.from_arrays([pa.array(end[e[:, 0]]), pa.array(end[e[:, 1]])], ["u", "v"])

        def cut(x: dict, last: bool):
            n = len(x["key"])
            new = [0, *edges(x).tolist()]
            limit = n if last else new[-1]
            ends = [s for s in new[1:] if s <= limit] + ([n] if last else [])
            runs, a = [], 0
            for k, e in enumerate(ends):
                if e - a >= TILE or k + 1 == len(ends):
                    runs.append((a, e))
                    a = e
            return [{k: v[p:q] for k, v in x.items()} for p, q in runs if q > p], {k: v[limit:] for k, v in x.items()}

        for b in batches:
            new = {k: b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in b.schema.names}
            kept = {k: np.concatenate([kept[k], v]) for k, v in new.items()} if kept else new
            runs, kept = cut(kept, False)
            for r in runs:
                yield solve(r)
        if kept and len(kept["key"]):
            for r in cut(kept, True)[0]:
                yield solve(r)

    return run


def links(scratch: common.Scratch, nodes: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """nodes (node long, fp long; distinct fp) -> links (u, v) that connect what lies within the radius."""
    width = 64 // segments
    keys = []
    for n, chosen in enumerate(combinations(range(segments), segments - radius)):
        mask = sum(((1 << width) - 1) << (width * s) for s in chosen)
        mask -= (1 << 64) if mask >> 63 else 0
        keys.append(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(mask).cast("long"))))
    rows = nodes.select("node", "fp", F.explode(F.array(*keys)).alias("key"))
    units = common.in_blocks(scratch, rows, "key", "fp", block)
    spread = units.repartition(common.tasks(nodes.sparkSession), "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return spread.select("key", "bi", "bj", "side", "fp", "node").mapInArrow(link(radius), "u long, v long")


def components(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fp, component_id), a row each.

    component_id is the smallest doc_id that can be reached over links of at
    most RADIUS differing bits. Equal fingerprints, thus exact copies, meet in
    an aggregate before anything is compared. Rows with a null doc_id link
    like others but never give their id; a component of nulls alone has a null
    component_id. Repeated rows each come back; an empty table gives none.
    """
    spark = docs.sparkSession
    s = common.Scratch(spark, "simhash")
    fps = s.table(fingerprints(docs), "fp")
    group = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    nodes = s.table(group.select(F.coalesce("low", F.lit(9223372036854775807)).alias("low"), "fp"), "nodes")
    edges = s.table(links(s, nodes.select(F.col("fp").alias("node"), "fp")), "links")
    comp = common.connected_components(s, edges)
    named = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = s.table(named, "named")
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = named.join(least, "root").select("fp", F.expr("nullif(component_id, 9223372036854775807)").alias("component_id"))
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = components(common.table(spark, sf_dir, "documents"))
    return c.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
