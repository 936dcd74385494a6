import random

import numpy as np
from pyspark.sql import functions as F

from fraudloom.llm import neardup, simhash
from tests_llm_brute import slow_kept


def changed(r, words, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return w


def corpus(r):
    texts, d = {}, 0
    for g in range(30):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([3, 8, 40, 120, 400]))]
        for _ in range(r.choice([1, 2, 4, 90 if g == 5 else 3])):
            texts[d] = " ".join(changed(r, base, r.choice([0, 0, 1, 2, max(1, len(base) // 50), len(base) // 20])))
            d += 1
    return texts | {d: "", d + 1: None, d + 2: " \n", d + 3: "one", d + 4: "One"}


def test_radius_counters():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**64, 200, np.uint64)
    fp[100:] = fp[:100] ^ (rng.integers(0, 2**64, 100, np.uint64) & rng.integers(0, 2**64, 100, np.uint64) & rng.integers(0, 2**64, 100, np.uint64))
    for r in (0, 1, 2, 3, 4, 6, 7, 8, 15, 20, 31, 40):
        hit = np.unpackbits(simhash.near(fp, simhash.planes(fp), np.zeros((200, 4), np.uint64), r).view(np.uint8), axis=1, bitorder="little")[:, :200]
        assert (hit == (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= r)).all()


def test_against_all_pairs(spark, monkeypatch):
    texts = corpus(random.Random(8))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = slow_kept(texts)
    assert {r.doc_id for r in neardup.near_dedup(df).collect()} == want and len(want) < len(texts) / 2
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "FAMILY_BLOCK", 2)
    assert {r.doc_id for r in neardup.near_dedup(df).collect()} == want


def test_a_chain_that_no_star_covers(spark):
    """Each text is near its neighbours only, so most links are found among families."""
    base = [f"w{k}" for k in range(300)]
    texts = {}
    for d in range(25):
        w = list(base)
        for k in range(d):
            w[k * 11 : k * 11 + 11] = [f"n{k}_{j}" for j in range(11)]
        texts[d] = " ".join(w)
    texts[99] = "quite another text of its own that nobody else has written"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in neardup.near_dedup(df).collect()} == slow_kept(texts) == {0, 99}


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert {r.doc_id for r in neardup.near_dedup(docs).collect()} == slow_kept({r.doc_id: r.text for r in docs.collect()})


def test_edge_rows(spark):
    df = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (7, None), (8, ""), (None, "z"), (2, "p q r s t u"), (2, "P q r s t U"), (5, "k"), (5, "k"), (6, "long " * 30_000), (9, "other")], "doc_id long, text string")
    df = df.withColumn("fp", F.lit("clash")).withColumn("node", F.lit(1)).withColumn("tk", F.lit(2)).withColumn("row", F.lit(3)).withColumn("_copy", F.col("doc_id"))
    out = neardup.near_dedup(df)
    assert out.columns == df.columns and {(r.fp, r.node, r.tk, r.row) for r in out.collect()} == {("clash", 1, 2, 3)} and all(r._copy == r.doc_id for r in out.collect())
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "5", "6", "7", "9", "None", "None"]
    assert neardup.near_dedup(df.limit(0)).count() == 0
