"""Near-dedup of documents (operator 4 as a stage): SimHash planes inside blocks, links verified on shingle sets.

Two documents are near copies if the sets of their five-word shingles have a
Jaccard similarity of 0.8 or more. At that similarity some 10 of 64 SimHash
bits differ, too many for segments of the fingerprint to select anything. So
blocks are keyed by the least shingle hashes (BANDS keys of ROWS least hashes
each; a pair at 0.8 shares none with probability 1e-5), and inside a block the
bit planes of the fingerprints are compared, RADIUS bits apart at most (some
3.5 standard deviations over the mean at 0.8). What remains is verified.

Equal sets meet in an aggregate first. Then each document is verified against
the smallest one of its blocks: that links the bulk of a large group at the
cost of one comparison a document. Only blocks that still hold different
groups are compared further, what is linked against what is not, as families
of documents whose fingerprints are near; there the sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 20
BANDS, ROWS = 16, 3
BLOCK, FAMILY_BLOCK = 4096, 256
_MAX = 9223372036854775807


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n odd factors and n summands: each pair permutes the 64-bit numbers."""
    draw = np.random.default_rng(simhash.SEED).integers(0, 2**64, (2, n), np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def least_keys(h: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """Hashes of each band's least permuted shingle hashes; none for an empty set."""
    if not len(h):
        return []
    f, s = _factors(bands * rows)
    low = np.full(len(f), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(h), 4096):
        np.minimum(low, (h[i : i + 4096, None] * f + s).min(axis=0), out=low)
    return [xxhash.xxh64_intdigest(low[k * rows : (k + 1) * rows].tobytes(), k) for k in range(bands)]


def _signed(x: list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def _sketch(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp, keys = [], [], []
            for text in b.column("text").to_pylist():
                h = np.unique(simhash.shingle_hashes(text, shingle))
                node.append(xxhash.xxh64_intdigest(h.tobytes()))
                fp.append(simhash.majority(h))
                keys.append(_signed(least_keys(h)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tk"), pa.array(_signed(node)), pa.array(_signed(fp)), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "tk", "node", "fp", "keys"])

    return run


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets (sorted, distinct) reach the similarity."""
    small, large = sorted((len(a), len(b)))
    if small < similarity * large:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (small + large - shared)


def _verify_pairs(shingle: int, similarity: float):
    """(u, v, tu, tv) -> the pairs (u, v) that are similar; the last set of the right side is kept, as it repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, np.zeros(0, np.uint64)
        for b in batches:
            u, v = b.column("u").to_numpy(), b.column("v").to_numpy()
            ok = np.zeros(len(u), bool)
            for k, (tu, tv) in enumerate(zip(b.column("tu").to_pylist(), b.column("tv").to_pylist())):
                if v[k] != last:
                    last, seen = v[k], np.unique(simhash.shingle_hashes(tv, shingle))
                ok[k] = similar(np.unique(simhash.shingle_hashes(tu, shingle)), seen, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(u[ok]), pa.array(v[ok])], ["u", "v"])

    return run


def _verify_families(shingle: int, similarity: float, radius: int):
    """Units sorted by (key, bi, bj) -> links of similar pairs; pairs that are connected by then aren't looked at."""
    def solve(rows: list, one: bool) -> list[tuple[int, int]]:
        node, root, side = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2))
        fp = np.array([r[3] for r in rows], np.int64).view(np.uint64)
        n = len(rows)
        i, j = simhash.pairs(fp, np.zeros(n, np.int64), side, np.full(n, one), radius, root)
        gap = np.bitwise_count(fp[i] ^ fp[j])
        sets: dict[int, np.ndarray] = {}
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := top.get(x, x)) != x:
                top[x] = top.get(p, p)
                x = p
            return x

        def shingles(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = np.unique(simhash.shingle_hashes(rows[k][4], shingle))
            return sets[k]

        out = []
        for p in np.argsort(gap, kind="stable").tolist():  # nearest first: what they connect needs no look
            a, b = int(i[p]), int(j[p])
            ra, rb = find(int(root[a])), find(int(root[b]))
            if ra != rb and similar(shingles(a), shingles(b), similarity):
                top[max(ra, rb)] = min(ra, rb)
                out.append((int(node[a]), int(node[b])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        names = ("key", "bi", "bj", "node", "root", "side", "fp", "text")
        for b in batches:
            found: list[tuple[int, int]] = []
            for key, bi, bj, *row in zip(*(b.column(c).to_pylist() for c in names)):
                if (key, bi, bj) != unit:
                    if len(rows) > 1:
                        found += solve(rows, unit[1] == unit[2])
                    unit, rows = (key, bi, bj), []
                rows.append(row)
            yield _links(found)
        if len(rows) > 1:
            yield _links(solve(rows, unit[1] == unit[2]))

    return run


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    e = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["u", "v"])


def _uneven(s: common.Scratch, rows: DataFrame, block: int) -> DataFrame:
    """rows (key, core, root, node, ...) -> units (key, bi, bj, side, ...): what isn't core against the core and against itself.

    The core is cut into chunks, the rest into blocks; a chunk meets each
    block (bi negative: the chunk), and each pair of blocks meets. A core of
    any size is thus sent once for each block of the rest, which mostly is one.
    """
    n = rows.groupBy("key").agg(F.count_if("core").alias("_c"), F.count_if(~F.col("core")).alias("_r")).filter("_r > 0 and _c + _r > 1")
    n = s.table(n.select("key", F.expr(f"cast(ceil(_c / {float(block)}D) as int)").alias("_nc"), F.expr(f"cast(ceil(_r / {float(block)}D) as int)").alias("_nr")), "counts")
    j = rows.join(n, "key").withColumn("_own", F.when(F.col("core"), F.pmod(F.xxhash64("node"), F.col("_nc"))).otherwise(F.pmod(F.xxhash64("node"), F.col("_nr"))).cast("int"))
    span = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    core = j.filter("core").withColumn("bj", F.explode(span("_nr"))).withColumn("bi", -1 - F.col("_own")).withColumn("side", F.lit(0))
    rest = j.filter("not core")
    met = rest.withColumn("_o", F.explode(span("_nc"))).withColumn("bj", F.col("_own")).withColumn("bi", -1 - F.col("_o")).withColumn("side", F.lit(1)).drop("_o")
    own = rest.withColumn("_o", F.explode(span("_nr"))).withColumn("bi", F.least("_own", "_o")).withColumn("bj", F.greatest("_own", "_o")).withColumn("side", (F.col("_own") == F.col("bj")).cast("int")).drop("_o")
    return core.unionByName(met).unionByName(own).drop("_nc", "_nr", "_own", "core")


def groups(s: common.Scratch, docs: DataFrame, shingle: int, similarity: float, radius: int) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, tk, text) -> (the sketch of each row, and (node, root) of the nodes that are linked to others)."""
    n = common.tasks(docs.sparkSession)
    rows = s.table(docs.mapInArrow(_sketch(shingle), "doc_id long, tk long, node long, fp long, keys array<long>"), "sketch")
    nodes = s.table(rows.groupBy("node").agg(F.min(F.struct("doc_id", "tk")).alias("at"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
    posted = nodes.select("node", "fp", F.explode("keys").alias("key"))
    blocks = posted.groupBy("key").agg(F.min("node").alias("rep"), F.count("*").alias("n")).filter("n > 1").select("key", "rep")
    blocks = s.table(blocks, "blocks")
    held = s.table(posted.join(blocks, "key"), "held")

    def texts(wanted: DataFrame) -> DataFrame:
        """(node, text) of the nodes in `wanted`, from the row each one stands for."""
        at = nodes.join(wanted.distinct(), "node", "left_semi").select("node", F.col("at.doc_id").alias("doc_id"), F.col("at.tk").alias("tk"))
        return docs.join(at, ["doc_id", "tk"]).select("node", "text").dropDuplicates(["node"])

    star = held.filter("node <> rep").groupBy("node").agg(F.min("rep").alias("rep"))
    star = s.table(star, "star")
    words = s.table(texts(star.select("node").union(star.select("rep"))), "texts")
    both = star.join(words.select("node", F.col("text").alias("tu")), "node").join(words.select(F.col("node").alias("rep"), F.col("text").alias("tv")), "rep")
    first = s.table(both.select(F.col("node").alias("u"), F.col("rep").alias("v"), "tu", "tv").mapInArrow(_verify_pairs(shingle, similarity), "u long, v long"), "first")
    one = s.table(common.connected_components(s, first), "one")

    rooted = held.join(one, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.min_by("root", "node").alias("main")).filter("_a <> _b").select("key", "main")
    rooted = s.table(rooted.join(mixed, "key").select("key", "node", "fp", "root", (F.col("root") == F.col("main")).alias("core")), "rooted")
    units = _uneven(s, rooted, BLOCK).repartition(n, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    close = s.table(units.select("key", "bi", "bj", "side", "fp", "node", "root").mapInArrow(simhash.link(radius), "u long, v long"), "close")

    family = s.table(common.connected_components(s, close), "family").select(F.col("node").alias("root"), F.col("root").alias("key"))
    members = rooted.select("node", "fp", "root").distinct().join(family, "root")
    main = members.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    members = s.table(members.join(main, "key").select("key", "node", "fp", "root", (F.col("root") == F.col("main")).alias("core")), "members")
    units = _uneven(s, members, FAMILY_BLOCK).join(words, "node").repartition(n, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    second = units.select("key", "bi", "bj", "node", "root", "side", "fp", "text").mapInArrow(_verify_families(shingle, similarity, radius), "u long, v long")
    second = s.table(second, "second")
    return rows.join(nodes.select("node"), "node", "left_semi"), s.table(common.connected_components(s, first.unionByName(second)), "groups")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Keeps of each group of near copies, linked directly or over others, the row with the smallest doc_id.

    Texts of fewer than `shingle` words are one shingle; all texts without
    words, null ones included, are copies of each other. Of rows that repeat
    a doc_id the one with the smallest text hash stands for it if texts
    differ, any if they don't. Rows with a null doc_id stay. An empty table
    gives no rows. Further columns come back as they are, whatever their
    names. Sets are told by 64 bits.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    s = common.Scratch(spark, "neardup")
    given = F.col("doc_id").cast("long")
    tk = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    slim = docs.select(given.alias("doc_id"), tk.alias("tk"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    rows, linked = groups(s, slim, shingle, similarity, radius)
    grouped = rows.select("doc_id", "tk", "node").join(linked, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("doc_id", "tk")).alias("at"))
    chosen = s.table(grouped.select("at.doc_id", "at.tk").groupBy("doc_id").agg(F.min("tk").alias("tk")), "chosen")
    twice = s.table(rows.groupBy("doc_id", "tk").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "tk"), "twice")
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), given.alias("doc_id"), tk.alias("tk"))
    single = inner.join(chosen, ["doc_id", "tk"], "left_semi").join(twice, ["doc_id", "tk"], "left_anti")
    repeated = inner.join(twice.join(chosen, ["doc_id", "tk"], "left_semi"), ["doc_id", "tk"], "left_semi").dropDuplicates(["doc_id", "tk"])
    empty = inner.filter("doc_id is null")
    return single.unionByName(repeated).unionByName(empty).select("row.*")
