import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from fraudloom.llm import simhash


def slow_fp(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    comp = {d: d for d in fps}
    ids = sorted(fps)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    m = min(comp[a], comp[b])
                    if comp[a] != m or comp[b] != m:
                        comp[a] = comp[b] = m
                        changed = True
    return comp


def test_fingerprint():
    for t in (None, "", " \n", "a", "A b", "É x Y", "a b c d\ne\x0bf  g a b c", "z" * 9999, "  q r " * 50):
        assert simhash.fingerprint(t) == slow_fp(t)


def test_near_counts():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, 130).astype(np.uint64)
    for k in range(0, 120, 3):
        fp[k + 1] = fp[k] ^ np.uint64(1 << int(rng.integers(64)))
        fp[k + 2] = fp[k + 1] ^ np.uint64(3 << int(rng.integers(62)))
    for r in (0, 1, 2, 3):
        skip = np.zeros((130, 3), np.uint64)
        hit = np.unpackbits(simhash.near(fp, simhash.planes(fp), skip, r).view(np.uint8), axis=1, bitorder="little")[:, :130]
        want = np.array([[(int(a) ^ int(b)).bit_count() <= r for b in fp] for a in fp])
        assert (hit == want).all()


def test_links_find_every_component(spark):
    rng = random.Random(5)
    fps = {}
    for g in range(60):
        f = rng.getrandbits(64)
        for k in range(rng.choice([1, 2, 5, 40 if g == 3 else 3])):
            fps[len(fps)] = f
            f ^= 1 << rng.randrange(64)
            f ^= (1 << rng.randrange(64)) * rng.randrange(2)
    from fraudloom.llm import common

    s64 = lambda x: x - (1 << 64) if x >> 63 else x
    for block in (4096, 7):
        df = spark.createDataFrame([(k, s64(v)) for k, v in fps.items()], "node long, fp long").dropDuplicates(["fp"])
        scratch = common.Scratch(spark, "t")
        got = {r.node: r.root for r in common.connected_components(scratch, simhash.links(scratch, df, block=block)).collect()}
        want = slow_components(fps)
        distinct = [r.node for r in df.collect()]
        for a in distinct:
            for b in distinct:
                assert (want[a] == want[b]) == (got.get(a, a) == got.get(b, b))


def test_query_against_brute_force(spark, sf_dir):
    rows = {r.doc_id: r for r in simhash.query(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {d: slow_fp(t) for d, t in texts.items()}
    comp = slow_components(fps)
    assert rows.keys() == texts.keys()
    for d in texts:
        assert rows[d].fingerprint == f"{fps[d]:016x}" and rows[d].component_id == comp[d]


def test_edge_rows(spark):
    df = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (1, "a b c d"), (None, "a b c d"), (7, None), (8, ""), (None, "other words here now")], "doc_id long, text string")
    df = df.withColumn("fp", F.lit("clash"))
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.components(df).collect())
    assert got == sorted([("3", "1"), ("3", "1"), ("1", "1"), ("None", "1"), ("7", "7"), ("8", "7"), ("None", "None")])
    assert simhash.components(df.limit(0)).count() == 0
