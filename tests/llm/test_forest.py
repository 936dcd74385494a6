import random
from collections import Counter

import numpy as np
import pytest
from tests_llm_brute import slow_sets

from fraudloom.llm import common, forest


def brute(rows, similarity=80, n=4):
    """(doc_id, size, component_id) of each row; all pairs compared."""
    sets = [slow_sets(t, n) - {()} for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= similarity * (len(sets[i]) + len(sets[j]) - shared):
                top[find(i)] = find(j)
    low = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            r = find(k)
            low[r] = min(low.get(r, d), d)
    return Counter((d, len(sets[k]), low.get(find(k)) if sets[k] else d) for k, (d, _) in enumerate(rows))


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    return Counter(map(tuple, forest.components(df, **more).collect()))


def families(seed, sizes=(30, 12, 5, 2, 2, 1, 1), words=90, vocabulary=4000, change=6):
    """Texts that drift away from a common start, so that a family is linked over steps."""
    rng = random.Random(seed)
    out = []
    for size in sizes:
        w = [str(rng.randrange(vocabulary)) for _ in range(rng.randint(words // 3, words))]
        for _ in range(size):
            w = list(w)
            for _ in range(rng.randrange(change)):
                k = rng.randrange(len(w))
                rng.choice([lambda: w.insert(k, "new%d" % rng.randrange(99)), lambda: w.pop(k), lambda: w.append("x")])()
            out.append(" ".join(w))
    rng.shuffle(out)
    return [(k, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_families_equal_all_pairs(spark, seed):
    rows = families(seed)
    got = run(spark, rows)
    assert got == brute(rows) and len({c for *_, c in got}) < len(rows)


def test_crowded_regions_go_deeper(spark):
    rng = random.Random(5)
    passage = " ".join(str(rng.randrange(999)) for _ in range(60))
    own = families(8, sizes=(6, 4, 3, 2, *[1] * 40), words=40)
    rows = [(k, f"{passage} {t}") for k, t in own]
    assert run(spark, rows, crowd=3) == run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(9, "One two three four five"), (3, "one TWO three four\tfive"), (None, "one two three four five"), (5, "a b"), (4, "a  b"), (7, "a b c"), (1, None), (2, ""), (6, " \n"), (9, "One two three four five"),
            (None, None), (None, "only null"), (None, "only null"), (11, "É É É É"), (10, "é é é é"), (12, "w " * 50_000 + "end"), (8, "w " * 50_000 + "end")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == Counter()
    d = spark.createDataFrame([(2, "a b", 1, 1), (1, "a b", 2, 2)], "doc_id long, text string, node int, `a.b` int")
    assert sorted(map(tuple, forest.components(d).collect())) == [(1, 1, 1), (2, 1, 1)]


def test_similarity_is_exact_at_the_border(spark):
    words = [f"w{k}" for k in range(21)]  # 18 shingles; one word less has 17 of them, other ends share 15 or 16
    a, b, c = " ".join(words), " ".join(words[:19]) + " x y", " ".join(words[2:]) + " p q"
    rows = [(1, a), (2, b), (3, c), (4, " ".join(words[:-3]))]
    assert run(spark, rows) == brute(rows)


def test_neighbours_share_the_longest_prefix():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    base = rng.integers(0, 4, forest.LABELS).astype(">u2")
    rows = []
    for k in range(50):
        x = base.copy()
        x[forest.LEAD + k % 9 :: 7] = k
        rows.append((0, x.tobytes(), k))
    rows.sort()
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], t) for c, t in ((0, pa.int32()), (1, pa.binary()), (2, pa.int64()))], ["tree", "labels", "node"]) for part in (rows[:1], rows[1:3], rows[3:])]
    found = {n: (o, a) for b in forest._neighbours(iter(batches)) for n, o, a in zip(*(b.column(c).to_pylist() for c in range(3)))}
    order = [r[2] for r in rows]
    labels = {r[2]: np.frombuffer(r[1], ">u2") for r in rows}
    for i, n in enumerate(order):
        counts = [int((labels[n] == labels[o]).sum()) for o in order[max(0, i - forest.NEAR) : i]]
        if counts and max(counts) >= forest.AGREE:
            assert found[n][1] == max(counts)
        else:
            assert n not in found


def test_regions_hold_nearly_all_similar_pairs():
    """Pairs at 0.8 to 0.82 share a region, and their planes differ in few bits."""
    rng = np.random.default_rng(3)
    lost = 0
    for _ in range(300):
        h = rng.integers(0, 2**63, 450, np.int64).astype(np.uint64)
        a, b = np.sort(h[:405]), np.sort(h[45:])  # 360 of 450
        x, y = forest.signature(a), forest.signature(b)
        lost += not set(forest.leads(x)) & set(forest.leads(y))
        assert (x == y).sum() >= forest.AGREE
    assert lost == 0


def test_table_equals_all_pairs(spark, sf_dir):
    df = common.table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = Counter(map(tuple, forest.components(df).collect()))
    assert got == brute(rows)
