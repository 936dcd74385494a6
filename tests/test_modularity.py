"""Greedy merges in flat arrays beside plain ones, and their growth."""

from __future__ import annotations

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from fraudloom.operators.modularity import by_component, communities_of
from tests.test_operators import plain_modularity


@pytest.mark.parametrize("seed", range(30))
def test_against_plain_merges(seed):
    """Random graphs, hubs with many leaves, groups; self-loops and links elsewhere in the graph."""
    r = random.Random(seed)
    n, p = r.randrange(2, 16), r.choice([0.1, 0.2, 0.5])
    pairs = {(a, b) for a in range(n) for b in range(a, n) if (b % 3 == a % 3 or a < 2) and r.random() < 2 * p or r.random() < p / 4} | {(0, n - 1)}
    ids, first, size = communities_of(*np.array(sorted(pairs), np.int32).T, len(pairs))
    groups = plain_modularity({(f"{a:02}", f"{b:02}") for a, b in pairs})
    member = {}
    for x, g in groups.items():
        member.setdefault(g, []).append(int(x))
    assert {int(i): (int(f), int(s)) for i, f, s in zip(ids, first, size)} == {x: (min(c), len(c)) for c in member.values() for x in c}


def test_components_run_over_batches():
    rows = [(1, 1, 2), (1, 2, 3), (1, 3, 3), (5, 5, 5), (7, 7, 8), (7, 7, 9)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, "int64") for c in (zip(*rows[k : k + n]) if n else ((), (), ()))], ["component", "a", "b"]) for k, n in ((0, 1), (1, 0), (1, 3), (4, 2))]
    whole = {c: set(np.concatenate([ids, first]).tolist()) for c, ids, first, _ in by_component(iter(batches), 6)}
    assert list(whole) == [1, 5, 7] and set().union(*whole.values()) == {1, 2, 3, 5, 7, 8, 9} and whole[5] == {5}


def test_hubs_with_many_leaves():
    """20,000 nodes that each pay half of 100: entering all of a hub's links anew at each merge took the square of them (4.7 s for 1,500 nodes)."""
    r = np.random.default_rng(3)
    a, b = np.nonzero(r.random((20_000, 100)) < 0.5)
    start = time.process_time()
    ids, _, size = communities_of(b.astype(np.int32), (a + 100).astype(np.int32), len(a))
    assert len(ids) == 20_100 and size.min() > 100 and time.process_time() - start < 30


def test_memory_a_link():
    """Rows of links that a merge touched were dicts and loading copied the pairs several times: 99 bytes a link at the peak."""
    r = np.random.default_rng(5)
    a, b = np.nonzero(r.random((8_000, 100)) < 0.5)
    cut = lambda k: pa.RecordBatch.from_arrays([pa.array(x[k : k + 10_000].astype(np.int64)) for x in (np.zeros(len(a)), b, a + 100)], ["component", "a", "b"])
    batches = [cut(k) for k in range(0, len(a), 10_000)]
    tracemalloc.start()
    try:
        _, ids, _, _ = next(by_component(iter(batches), len(a)))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(ids) == 8_100 and most < 60 * len(a), most / len(a)


@pytest.mark.parametrize("seed", range(6))
def test_rows_that_outgrow_their_place(seed):
    """Chains and bunches of leaves whose merged nodes get more links than either had."""
    r = random.Random(100 + seed)
    groups = [[(g, k) for k in range(r.randrange(2, 6))] for g in range(5)]
    names = {x: k for k, x in enumerate(x for g in groups for x in g)}
    pairs = {tuple(sorted((names[x], names[y]))) for g in groups for x, y in zip(g, g[1:])}
    pairs |= {tuple(sorted(r.sample(range(len(names)), 2))) for _ in range(2 * len(names))}
    _, first, size = communities_of(*np.array(sorted(pairs), np.int32).T, len(pairs))
    got = plain_modularity({(f"{a:02}", f"{b:02}") for a, b in pairs})
    assert sorted(zip(first.tolist(), size.tolist())) == sorted((min(c), len(c)) for c in [[int(y) for y in got if got[y] == g] for g in got.values()])
