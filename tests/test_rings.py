import random

import pytest

from fraudloom.operators import graph as G
from fraudloom.operators import rings as R


def edges(spark, rows):
    return spark.createDataFrame([(a, b, t, k) for k, (a, b, t) in enumerate(rows)], "src string, dst string, time long, seq long")


def reachable(rows):
    out = {}
    for a, b, *_ in rows:
        out.setdefault(a, set()).add(b)
    seen = {}
    for n in {x for r in rows for x in r[:2]}:
        todo, got = [n], {n}
        while todo:
            for m in out.get(todo.pop(), ()):
                if m not in got:
                    got.add(m)
                    todo.append(m)
        seen[n] = got
    return seen


@pytest.mark.parametrize("seed,n,m", [(1, 30, 45), (2, 12, 40), (3, 40, 30)])
def test_strong_components_equal_mutual_reach(spark, seed, n, m):
    rng = random.Random(seed)
    rows = [(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}", 0) for _ in range(m)]
    reach = reachable(rows)
    want = {a: max(b for b in reach[a] if a in reach[b]) for a in reach}
    assert {r.node: r.component for r in R.strong_components(edges(spark, rows)).collect()} == want


def test_strong_components_of_chains_and_nothing(spark):
    rows = [(f"a{k}", f"a{k + 1}", 0) for k in range(6)] + [("a6", "a0", 0), ("a3", "z", 0), ("y", "y", 0)]
    assert {r.node: r.component for r in R.strong_components(edges(spark, rows)).collect()} == {**{f"a{k}": "a6" for k in range(7)}, "z": "z", "y": "y"}
    assert R.strong_components(edges(spark, rows).limit(0)).collect() == []


def plain_rings(rows, span):
    """All simple cycles by depth-first search, then the definition."""
    t, out = {}, {}
    for a, b, x in rows:
        if a != b:
            t[a, b] = max(x, t.get((a, b), x))
    for a, b in t:
        out.setdefault(a, []).append(b)
    found = set()

    def visit(path):
        for m in out.get(path[-1], ()):
            if m == path[0] and len(path) > 1:
                times = [t[x, y] for x, y in zip(path, [*path[1:], path[0]])]
                ordered = any(all(p <= q for p, q in zip(r, r[1:])) for r in (times[k:] + times[:k] for k in range(len(times))))
                if ordered and max(times) - min(times) <= span:
                    found.add(">".join(path))
            elif m > path[0] and m not in path:
                visit([*path, m])

    for n in list(out):
        visit([n])
    return found


@pytest.mark.parametrize("seed,span", [(1, 10**6), (2, 12), (4, 0), (5, 2)])
def test_rings_equal_plain_search(spark, seed, span):
    rng = random.Random(seed)
    rows = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.randrange(-20, 20) // (1 if seed < 3 else 12)) for _ in range(34)]
    got = R.rings_within(edges(spark, rows), span).collect()
    assert sorted(r.ring for r in got) == sorted(plain_rings(rows, span))
    assert all(r.members == sorted(r.ring.split(">")) and r.length == len(r.members) for r in got)


def test_rings_without_bound_equal_the_other_search(spark, sf_dir):
    from fraudloom.sources import tables as T

    e = T.edges(spark, sf_dir, 24_000)
    assert sorted(r.ring for r in R.rings_within(e, 10**15).collect()) == sorted(r.ring for r in G.temporal_rings(e).collect())


def test_a_long_ring(spark):
    rows = [(f"n{k:02d}", f"n{(k + 1) % 25:02d}", 5 * k) for k in range(25)] + [("hub", "n03", 1), ("n03", "hub", 2)]
    assert {r.length for r in R.rings_within(edges(spark, rows), 120).collect()} == {2, 25}
    assert {r.length for r in R.rings_within(edges(spark, rows), 119).collect()} == {2}
