from pyspark.sql import functions as F

from fraudloom.llm import mixing


def brute_targets(sizes, weights, total):
    t = [0.0] * len(sizes)
    fixed = {k for k, s in enumerate(sizes) if s == 0}
    while True:
        left = total - sum(3 * sizes[k] for k in fixed)
        w = sum(weights[k] for k in range(len(sizes)) if k not in fixed)
        t = [3.0 * sizes[k] if k in fixed else left * weights[k] / w for k in range(len(sizes))]
        over = {k for k in range(len(sizes)) if k not in fixed and t[k] > 3 * sizes[k]}
        if not over:
            return t
        fixed |= over


def test_targets():
    for sizes in ([100, 100, 100], [10, 1000, 1000], [1, 1, 10_000, 5], [0, 50, 50], [7]):
        w = [mixing.WEIGHTS[k % 3] for k in range(len(sizes))]
        want = brute_targets(sizes, w, sum(sizes))
        assert all(abs(a - b) < 1e-6 for a, b in zip(mixing.targets(sizes, w), want))


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 3, 10, 401, 5000):
        d = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k")).alias("p"))
        r = d.agg(F.count_distinct("p"), F.min("p"), F.max("p")).first()
        assert tuple(r) == (n, 0, n - 1)
    p = [r.p for r in spark.range(1000).select(mixing.permuted(F.col("id"), F.lit(1000).cast("long"), F.lit("k")).alias("p")).collect()]
    assert sum(x == k for k, x in enumerate(p)) < 20


def test_draws_use_up_the_quotas():
    p = mixing.Plan(["a", "b", "c"], [1] * 3, [1] * 3, [0] * 3, [500, 30, 7])
    d = list(p.draws(shards=8))
    assert [sum(g[k] for _, g in d) for k in range(3)] == p.quota and len(d) == 8 and len({tuple(g) for _, g in d}) > 1
    assert [tuple(g) for _, g in p.draws(shards=8)] == [tuple(g) for _, g in d]


def test_blocks_tile_each_source(spark):
    d = spark.createDataFrame([(k, "s" if k % 3 else "t", k % 7 * 13) for k in range(60)], "doc_id long, key string, size long")
    d = d.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(5)).cast("int")).withColumn("rid", F.col("doc_id"))
    rows = mixing.pack(d, 16).collect()
    for key in "st":
        sizes = {}
        for r in rows:
            if r.key == key:
                sizes[r["index"]] = sizes.get(r["index"], 0) + r.n_words
        total = sum(k % 7 * 13 for k in range(60) if ("s" if k % 3 else "t") == key)
        assert sorted(sizes) == list(range(-(-total // 16))) and all(v == 16 for k, v in sizes.items() if k < max(sizes)) and sum(sizes.values()) == total
    for k in range(60):
        mine = sorted((r.from_word, r.n_words) for r in rows if r.doc_id == k)
        assert sum(n for _, n in mine) == k % 7 * 13 and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:]))


def test_table_and_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in mixing.account(docs).collect()}
    again = {r.doc_id: r for r in mixing.account(docs.repartition(5)).collect()}
    assert got == again
    by = {}
    for r in docs.select("doc_id", "source", "text").collect():
        g = got[r.doc_id]
        assert g.size == len(r.text.encode().split()) and g.taken <= 3 * g.size
        t = by.setdefault(r.source, [0, 0, g.target, g.source_size])
        t[0] += g.taken
        t[1] += g.size
    names = sorted(by)
    want = brute_targets([by[n][1] for n in names], [mixing.WEIGHTS[k % 3] for k in range(len(names))], sum(v[1] for v in by.values()))
    for n, t in zip(names, want):
        assert abs(by[n][2] - t) < 1e-6 * max(1, t) and by[n][3] == by[n][1] and abs(by[n][0] - t) <= 0.05 * t + mixing.BLOCK
    m = mixing.mix(docs)
    assert m.columns == docs.columns
    words = {}
    for r in m.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split(" "))
        assert r.n_chars == len(r.text)
    assert words == {k: g.taken for k, g in got.items() if g.taken}


def test_edge_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", None), (None, "c d e", None), (5, "w " * 9000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("key", F.lit(1))
    got = mixing.account(df).collect()
    assert sorted((str(r.doc_id), r.size, r.source_size) for r in got) == sorted([("1", 2, 4), ("1", 2, 4), ("2", 0, 4), ("3", 0, 3), ("None", 3, 3), ("5", 9000, 9000)])
    assert all(r.taken <= 3 * r.size for r in got) and mixing.account(df.limit(0)).count() == 0
    assert [r.taken for r in mixing.account(spark.createDataFrame([(1, "", "x")], "doc_id long, text string, source string")).collect()] == [0]


def test_mixture_keeps_columns_of_any_name(spark):
    rows = [(k, f"some words of text {k}", "a" if k % 3 else None, k, "x") for k in range(30)] + [(40, None, "a", 1, "x"), (41, "", None, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key int, `a.b` string")
    got = mixing.mix(df, block=8)
    assert got.columns == df.columns and {r["a.b"] for r in got.collect()} == {"x"} and not {r.doc_id for r in got.collect()} & {40, 41}
    assert mixing.mix(df.limit(0)).collect() == []
