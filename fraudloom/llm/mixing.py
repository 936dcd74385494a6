"""Mixing sources to target weights (operator 5).

Words are packed, source by source, into blocks of BLOCK words (the last block
of a source may be shorter). Each of SHARDS output shards draws multinomial
counts per source; slot k of a source takes block perm(k mod N) of its N
blocks, perm being a pseudorandom permutation keyed by source and epoch, and
slots meet blocks in a join by (source, index).

Positions come from two-level prefix sums: a source's documents are ordered by
(bucket, doc_id), bucket a hash of the row, so a source with a third of all
rows is summed in BUCKETS pieces and only their totals are cumulated.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK = 64
SHARDS = 256
RUN = 16_384
WALK = 40
BUCKETS = 512
SEED = 20_240


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float | None = None, max_epochs: int = MAX_EPOCHS) -> list[float]:
    """Words for each source: shares by weight of the total, no source above max_epochs times its size.

    What is above is shared again by weight among the others until none is.
    """
    total = float(sum(sizes)) if total is None else float(total)
    out = [0.0] * len(sizes)
    free = [k for k, s in enumerate(sizes) if s > 0]
    left = total
    while free:
        w = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / w > max_epochs * sizes[k]]
        if not over:
            for k in free:
                out[k] = left * weights[k] / w
            break
        for k in over:
            out[k] = float(max_epochs * sizes[k])
        left -= sum(out[k] for k in over)
        free = [k for k in free if k not in over]
    return out


def _name(source: Column) -> Column:
    """A key that orders by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


@dataclass
class Plan:
    """Of each source, in order: key, size in words, blocks, target words, quota of slots."""

    keys: list[str]
    sizes: list[int]
    blocks: list[int]
    target: list[float]
    quota: list[int]

    def draws(self, shards: int = SHARDS, seed: int = SEED):
        """(shard, counts by source): multinomial over what each source still has to give.

        A draw above a source's quota goes back and is drawn again among the
        others, so the counts of all shards add up to the quotas exactly.
        """
        left = np.array(self.quota, np.int64)
        shard, slots = 0, -(-int(left.sum()) // shards)
        while (room := int(min(slots, left.sum()))) > 0:
            rng = np.random.default_rng((seed, shard))
            got = np.zeros_like(left)
            while room > 0:
                rest = left - got
                got += np.minimum(rng.multinomial(room, rest / rest.sum()), rest)
                room = int(min(slots, left.sum())) - int(got.sum())
            left -= got
            yield shard, got
            shard += 1


def plan(sized: DataFrame, block: int = BLOCK, weights: tuple[float, ...] = WEIGHTS) -> Plan:
    """One row a source comes to the driver; sources are few beside documents."""
    rows = sorted((r.key, int(r.size)) for r in sized.groupBy("key").agg(F.sum("size").alias("size")).collect())
    keys, sizes = [k for k, _ in rows], [s for _, s in rows]
    target = targets(sizes, [weights[k % len(weights)] for k in range(len(rows))])
    blocks = [-(-s // block) for s in sizes]
    # The last block of a source may be short, so slots are counted by the mean block.
    quota = [min(MAX_EPOCHS * n, round(t * n / s)) if s else 0 for t, n, s in zip(target, blocks, sizes)]
    return Plan(keys, sizes, blocks, target, quota)


def permuted(index: Column, n: Column, key: Column) -> Column:
    """Pseudorandom permutation of 0..n-1: four Feistel rounds over a square of side ceil(sqrt(n)).

    A round shifts one digit by a hash of the other, which is one to one.
    Places of the square outside 0..n-1 are sent through again until inside
    (cycle walking, also one to one). Fewer than 2 * side places are outside:
    WALK steps are certain to suffice for n up to 400, and beyond that fail
    with odds under 0.1 ** WALK.
    """
    side = F.ceil(F.sqrt(n.cast("double"))).cast("long")

    def rounds(x: Column) -> Column:
        hi, lo = F.floor(x / side).cast("long"), F.pmod(x, side)
        for r in range(4):
            hi, lo = lo, F.pmod(hi + F.pmod(F.xxhash64(lo, key, F.lit(r)), side), side)
        return hi * side + lo

    first = rounds(index)  # inside for nearly all; only the others walk
    return F.when(first < n, first).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda x, _: F.when(x >= n, rounds(x)).otherwise(x)))


def pack(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs with key, size, order columns -> one row a (document, block): key, index, from_word, n_words and the document's columns.

    from_word counts from 1 inside the document.
    """
    start = _starts(docs)
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    b = start.filter("size > 0").withColumn("index", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("start"), F.col("index") * block)
    hi = F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * block)
    return b.withColumn("from_word", lo - F.col("start") + 1).withColumn("n_words", hi - lo).drop("start")


def _starts(docs: DataFrame) -> DataFrame:
    """Adds start: words of the source before the document."""
    inner = Window.partitionBy("key", "bucket").orderBy("doc_id", "rid").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = docs.groupBy("key", "bucket").agg(F.sum("size").alias("total"))
    heads = heads.select("key", "bucket", F.coalesce(F.sum("total").over(outer), F.lit(0)).alias("head"))
    rows = docs.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return rows.join(heads, ["key", "bucket"]).withColumn("start", F.col("head") + F.col("before")).drop("head", "before")


def slots(spark: SparkSession, p: Plan, shards: int = SHARDS) -> DataFrame:
    """One row a slot: shard, key, slot (its number within the source), index (of the block).

    The driver holds a row for each shard and source; these are cut into runs
    of RUN slots, dealt out and unfolded on the executors.
    """
    done = np.zeros(len(p.keys), np.int64)
    drawn = []
    for shard, got in p.draws(shards):
        drawn += [(shard, p.keys[k], int(done[k]), int(done[k] + got[k]), p.blocks[k]) for k in np.flatnonzero(got).tolist()]
        done += got
    rows = spark.createDataFrame(drawn, "shard long, key string, a long, b long, blocks long")
    runs = rows.select("shard", "key", "blocks", "b", F.explode(F.sequence("a", F.col("b") - 1, F.lit(RUN).cast("long"))).alias("a")).repartition(common.tasks(spark))
    one = runs.select("shard", "key", "blocks", F.explode(F.sequence("a", F.least(F.col("b"), F.col("a") + RUN) - 1)).alias("slot"))
    epoch = F.floor(F.col("slot") / F.col("blocks"))
    return one.withColumn("index", permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.concat_ws(":", F.col("key"), epoch.cast("string")))).drop("blocks")


def _sized(docs: DataFrame, scratch: common.Scratch, keep_text: bool) -> DataFrame:
    d = docs.select(F.col("doc_id"), _name(F.col("source")).alias("key"), n_words(F.col("text")).alias("size"), *([F.col("text")] if keep_text else []),
                    *[F.col(f"`{c}`").alias(f"o_{c}") for c in docs.columns if keep_text and c not in ("doc_id", "text", "n_chars")])
    d = d.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))
    return scratch.table(d.withColumn("rid", F.monotonically_increasing_id()), "sized")


def account(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text, source) -> a row each: doc_id, size, source_size, target, taken.

    Null texts have no words and are taken 0 times; null sources form the last
    source; a null doc_id is a document like others; repeated rows are packed
    each for itself; a table without words has target 0 everywhere, and an
    empty one gives no rows. Further columns are ignored.
    """
    spark = docs.sparkSession
    s = common.Scratch(spark, "mix")
    sized = _sized(docs, s, False)
    p = plan(sized, block)
    taken = _times(spark, pack(sized, block).select("rid", "key", "index", "n_words"), p).groupBy("rid").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
    facts = F.broadcast(spark.createDataFrame(list(zip(p.keys, p.sizes, p.target)), "key string, source_size long, target double"))  # a row a source
    return sized.join(facts, "key").join(taken, "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _times(spark: SparkSession, packed: DataFrame, p: Plan) -> DataFrame:
    """Joins blocks with the number of slots that took them."""
    drawn = slots(spark, p).groupBy("key", "index").agg(F.count("*").alias("times"))
    # Made from a few runs, slots look small to the planner; they are as many as the blocks.
    return packed.join(drawn.hint("merge"), ["key", "index"])


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mixture as rows with docs' columns: one a (slot, document piece), text its words joined by blanks.

    Rows of a block that several slots took repeat. doc_id and the other
    columns are the document's, whatever their names; n_chars, if there, is
    the piece's length. Null and empty texts have no pieces; null sources form
    the last source; repeated rows are packed each for itself; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    s = common.Scratch(spark, "mix")
    sized = _sized(docs, s, True)
    p = plan(sized, block)
    packed = pack(sized.drop("text", *[c for c in sized.columns if c.startswith("o_")]), block).select("rid", "key", "index", "from_word", "n_words")
    pieces = _times(spark, packed, p).groupBy("rid").agg(F.collect_list(F.struct("from_word", "n_words", "times")).alias("pieces"))
    full = sized.join(pieces, "rid")
    words = F.regexp_extract_all("text", F.lit(common.WORD), F.lit(0))

    def cut(w: Column) -> Column:
        return F.transform("pieces", lambda x: F.struct(F.array_join(F.slice(w, x["from_word"].cast("int"), x["n_words"].cast("int")), " ").alias("text"), x["times"].cast("int").alias("times")))

    texts = F.flatten(F.transform(F.array(words), cut))  # binds the words once for all pieces
    one = full.withColumn("piece", F.explode(texts)).withColumn("text", F.col("piece.text")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("piece.times"))))
    cols = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) if c in ("doc_id", "text") else F.col(f"`o_{c}`").alias(c) for c in docs.columns]
    return one.select(*cols)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return account(common.table(spark, sf_dir, "documents"))
