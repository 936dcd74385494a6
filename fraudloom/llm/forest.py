"""MinHash near-duplicates by an LSH forest (operator 12).

A text's set: its distinct 4-word shingles (A-Z lower-cased, words parted by
ASCII white space; of a shorter text the whole sequence). Its signature: 72
least permuted shingle hashes. The forest's trees are 24 orders of the same
documents, each by the signature rotated by three more labels, so the three
labels that lead an order are its own. Documents that share an order's leading
three labels are a region; a pair at 0.8 is in no common region with
probability (1 - 0.8^3)^24, 3e-8.

Equal sets meet in an aggregate first. In each order a document's candidates
are then the neighbours with which it has the longest common prefix, so the
depth follows from how dense its region is: thousands of near copies meet at
dozens of equal labels, lone pairs at three. Links of these neighbours connect
the bulk of every group. What a region then still holds of other groups is
compared within it, by one bit of each label as planes, and verified on the
sets. A region that still holds many goes one level deeper: documents in two
such regions are compared where both agree, at six labels. Pairs at 0.8 that
share one region only, and a crowded one, are lost with probability 8e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, neardup, simhash

SHINGLE, SIMILARITY = 4, 0.8
ORDERS, LEAD = 24, 3
LABELS = ORDERS * LEAD
#: Neighbours looked at before a row of an order; labels that a pair must share to be verified (at 0.8 it shares 58 of 72, give or take 3.4); bits of 64 that may differ (6.4, give or take 2.4).
NEAR, AGREE, RADIUS = 4, 36, 20
#: Neighbours of a document that are verified first, those with most labels in common; one alone would leave a third of a group's documents in pairs of their own.
LINKS = 4
#: Documents of other groups from which on a region goes one level deeper.
CROWD = 8192
_MAX = 9223372036854775807
_MIX = np.uint64(0x9E3779B97F4A7C15)


def signature(h: np.ndarray) -> np.ndarray:
    """Least of each of LABELS permutations of a set's hashes."""
    f, s = neardup._factors(LABELS)
    low = np.full(LABELS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(h), 2048):
        np.minimum(low, (h[i : i + 2048, None] * f + s).min(axis=0), out=low)
    return low


def leads(sig: np.ndarray) -> list[int]:
    """A hash of the leading labels of each order."""
    return [xxhash.xxh64_intdigest(sig[k * LEAD : (k + 1) * LEAD].tobytes(), k) for k in range(ORDERS)]


def _signed(x: list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def _sketch(shingle: int):
    """(doc_id, tk, text) -> what stands for the text; node null and nothing else where the set is empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, node, fp, labels, keys = [], [], [], [], []
            for text in b.column("text").to_pylist():
                h = np.unique(simhash.shingle_hashes(text, shingle))
                size.append(len(h))
                if not len(h):
                    for x in (node, fp, labels, keys):
                        x.append(None)
                    continue
                sig = signature(h)
                mixed = (sig ^ (sig >> np.uint64(29))) * _MIX
                node.append(int(_signed([xxhash.xxh64_intdigest(h.tobytes())])[0]))
                fp.append(int(np.packbits(mixed[:64] >> np.uint64(63) == 1, bitorder="little").view(np.int64)[0]))
                labels.append((mixed >> np.uint64(40)).astype(">u2").tobytes())
                keys.append(_signed(leads(sig)).tolist())
            cols = [b.column("doc_id"), b.column("tk"), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(fp, pa.int64()), pa.array(labels, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "tk", "n_shingles", "node", "fp", "labels", "keys"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, labels, node) in order -> of each row the one before it, of the NEAR nearest in its region, that it shares most labels with."""
    tree, node, labels = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, LABELS), np.uint16)
    for b in batches:
        old = len(node)
        tree = np.concatenate([tree, b.column("tree").to_numpy().astype(np.int64)])
        node = np.concatenate([node, b.column("node").to_numpy()])
        new = np.frombuffer(b"".join(b.column("labels").to_pylist()), ">u2").astype(np.uint16).reshape(-1, LABELS)
        labels = np.concatenate([labels, new])
        best, other = np.zeros(len(node) - old, np.int64), np.zeros(len(node) - old, np.int64)
        for back in range(1, NEAR + 1):
            i = np.arange(max(old, back), len(node))
            same = labels[i] == labels[i - back]
            n = np.where((tree[i] == tree[i - back]) & same[:, :LEAD].all(axis=1), same.sum(axis=1), 0)
            better = n > best[i - old]
            best[(i - old)[better]], other[(i - old)[better]] = n[better], node[(i - back)[better]]
        ok = best >= AGREE
        yield pa.RecordBatch.from_arrays([pa.array(node[old:][ok]), pa.array(other[ok]), pa.array(best[ok])], ["node", "other", "agree"])
        tree, node, labels = tree[-NEAR:], node[-NEAR:], labels[-NEAR:]


def _mixed(rows: DataFrame) -> DataFrame:
    """rows (key, node, fp, root) of keys with several groups, with core: whether a row is of the key's largest group."""
    each = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = each.groupBy("key").agg(F.count("*").alias("k"), F.max(F.struct("n", "root"))["root"].alias("main")).filter("k > 1").select("key", "main")
    return rows.join(main, "key").select("key", "node", "fp", "root", (F.col("root") == F.col("main")).alias("core"))


def _deeper(crowded: DataFrame) -> DataFrame:
    """Rows of crowded regions -> the same documents by each two of these regions that they are in."""
    each = crowded.groupBy("node", "fp", "root").agg(F.sort_array(F.collect_set("key")).alias("k")).filter("size(k) > 1")  # ORDERS at most
    two = F.expr("flatten(transform(sequence(1, size(k) - 1), i -> transform(slice(k, i + 1, size(k)), y -> xxhash64(k[i - 1], y))))")
    return each.select(F.explode(two).alias("key"), "node", "fp", "root")


def groups(s: common.Scratch, docs: DataFrame, shingle: int, similarity: float, crowd: int) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id not null, tk, text) -> (doc_id, tk, n_shingles, node of each row; (node, root) of the nodes that are linked to others)."""
    n = common.tasks(docs.sparkSession)
    rows = s.table(docs.mapInArrow(_sketch(shingle), "doc_id long, tk long, n_shingles long, node long, fp long, labels binary, keys array<long>"), "sketch")
    some = rows.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "tk")).alias("at"), F.first("fp").alias("fp"), F.first("labels").alias("labels"), F.first("keys").alias("keys"))
    nodes = s.table(some, "nodes")
    posted = nodes.select("node", "fp", F.posexplode("keys").alias("tree", "key"))
    regions = s.table(posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "regions")
    held = s.table(posted.join(regions, "key"), "held")

    def texts(wanted: DataFrame) -> DataFrame:
        """(node, text) of the nodes in `wanted`, each from the row that stands for it."""
        at = nodes.join(wanted.distinct(), "node", "left_semi").select("node", F.col("at.doc_id").alias("doc_id"), F.col("at.tk").alias("tk"))
        return docs.join(at, ["doc_id", "tk"]).select("node", "text").dropDuplicates(["node"])

    turned = F.expr(f"concat(substring(labels, {2 * LEAD} * tree + 1), substring(labels, 1, {2 * LEAD} * tree))")
    orders = s.table(held.select("node", "tree").join(nodes.select("node", "labels"), "node").select("tree", turned.alias("labels"), "node"), "orders")
    order = orders.repartitionByRange(n, "tree", "labels", "node").sortWithinPartitions("tree", "labels", "node")
    best = order.mapInArrow(_neighbours, "node long, other long, agree long").groupBy("node").agg(F.sort_array(F.collect_set(F.struct("agree", "other")), asc=False).alias("x"))  # ORDERS at most
    near = best.select("node", F.explode(F.slice("x", 1, LINKS)["other"]).alias("other"))
    near = s.table(near.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct(), "near")
    words = s.table(texts(near.select(F.col("u").alias("node")).union(near.select("v"))), "texts")
    both = near.join(words.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u").join(words.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")
    first = s.table(both.select("u", "v", "tu", "tv").mapInArrow(neardup._verify_pairs(shingle, similarity), "u long, v long"), "first")
    one = s.table(common.connected_components(s, first), "one")

    rooted = held.drop("tree").join(one, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = s.table(_mixed(rooted), "mixed")
    crowds = s.table(rooted.groupBy("key").agg(F.count_if(~F.col("core")).alias("n")).filter(F.col("n") > crowd).select("key"), "crowds")
    deep = s.table(_deeper(rooted.join(crowds, "key", "left_semi")), "deep")
    level = rooted.join(crowds, "key", "left_anti").unionByName(_mixed(deep))
    level = s.table(level, "level")
    units = neardup._uneven(s, level, neardup.BLOCK).repartition(n, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    close = s.table(units.select("key", "bi", "bj", "side", "fp", "node", "root").mapInArrow(simhash.link(RADIUS), "u long, v long"), "close")

    family = s.table(common.connected_components(s, close), "family").select(F.col("node").alias("root"), F.col("root").alias("key"))
    members = s.table(_mixed(level.select("node", "fp", "root").distinct().join(family, "root").select("key", "node", "fp", "root")), "members")
    told = s.table(texts(members.select("node")), "told")
    units = neardup._uneven(s, members, neardup.FAMILY_BLOCK).join(told, "node").repartition(n, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    second = units.select("key", "bi", "bj", "node", "root", "side", "fp", "text").mapInArrow(neardup._verify_families(shingle, similarity, RADIUS), "u long, v long")
    second = s.table(second, "second")
    return rows.select("doc_id", "tk", "n_shingles", "node"), s.table(common.connected_components(s, first.unionByName(second)), "groups")


def components(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id), a row each.

    component_id is the smallest doc_id that can be reached over links of sets
    at least so similar; equal sets are linked. Texts without words, null ones
    included, are linked with nothing. Rows with a null doc_id link like others
    but never give their id; a component of nulls alone has a null
    component_id. Repeated rows each come back, long texts are taken whole, an
    empty table gives no rows, further columns are ignored. Sets are told by
    64 bits.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    s = common.Scratch(spark, "forest")
    text = F.col("text").cast("string")
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_MAX)).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tk"), text.alias("text"))
    rows, linked = groups(s, slim, shingle, similarity, crowd)
    named = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("low")).join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = s.table(named, "named")
    least = named.groupBy("root").agg(F.min("low").alias("low"))
    ids = named.select("node", "root").join(least, "root").select("node", "low")
    out = rows.join(ids, "node", "left").select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"))
    null = lambda c: F.when(F.col(c) != _MAX, F.col(c)).alias(c)
    return out.select(null("doc_id"), "n_shingles", null("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = components(common.table(spark, sf_dir, "documents"))
    return c.withColumn("kept", F.col("doc_id") == F.col("component_id"))


#: Every pair that shares a shingle, then what can be reached over links.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))) END AS s FROM words),
kinds AS (SELECT list_sort(s) AS s, min(r) AS k, min(doc_id) AS low FROM sets WHERE len(s) > 0 GROUP BY 1),
parts AS (SELECT k, len(s) AS n, unnest(s) AS g FROM kinds),
links AS (
  SELECT a.k AS u, b.k AS v FROM parts a JOIN parts b ON a.g = b.g AND a.k <> b.k AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT k, k AS there FROM kinds UNION SELECT reach.k, v FROM reach JOIN links ON u = there),
named AS (SELECT reach.k, min(kinds.low) AS component_id FROM reach JOIN kinds ON kinds.k = reach.there GROUP BY 1)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END AS component_id, doc_id = CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END AS kept
FROM sets LEFT JOIN kinds ON kinds.s = list_sort(sets.s) LEFT JOIN named ON named.k = kinds.k
"""
