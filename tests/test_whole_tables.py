"""The *_all queries, and those without SQL, over every row of their tables."""

from collections import deque

import pytest

from fraudloom.plans import catalog
from fraudloom.sources import tables as T


@pytest.fixture(scope="module")
def pairs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id", "cast(get_json_object(props, '$.k') as int) as k").collect()
    return [(f"n{r.user_id}", f"n{r.k}") for r in rows]


def roots(pairs):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        top[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in top}


def test_every_transfer_and_order_is_there(spark, sf_dir, pairs):
    assert sorted((r.src, r.dst) for r in T.edges(spark, sf_dir).collect()) == sorted(pairs)
    orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert T.ledger(spark, sf_dir).count() == orders


def test_components_and_distances(spark, sf_dir, pairs):
    assert {r.node: r.component for r in catalog.QUERIES["graph_components_all"](spark, sf_dir).collect()} == roots(pairs)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    dist = {n: 0 for n in ("n1", "n2", "n3") if n in near}
    todo = deque(dist)
    while todo:
        a = todo.popleft()
        for b in near[a] - dist.keys():
            dist[b] = dist[a] + 1
            todo.append(b)
    assert {r.node: r.dist for r in catalog.QUERIES["dist_to_bad_all"](spark, sf_dir).collect()} == {n: dist.get(n, -1) for n in near}


def test_address_clusters(spark, sf_dir):
    ins, outs = {}, {}
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey o", "l_partkey p", "l_suppkey s", "cast(round(l_extendedprice * 100) as long) v").collect():
        ins.setdefault(r.o, set()).add(f"p{r.p}")
        outs.setdefault(r.o, []).append((f"s{r.s}", r.v))
    joined = [(a, a) for o in ins for a in (*ins[o], *(x for x, _ in outs[o]))]
    for o, a in ins.items():
        values = [v for _, v in outs[o]]
        if len(a) < 3 or max(map(values.count, values)) < 3:
            joined += [(min(a), x) for x in a]
    assert {r.address: r.cluster for r in catalog.QUERIES["address_clusters_all"](spark, sf_dir).collect()} == roots(joined)


@pytest.mark.parametrize("name", ["communities", "label_propagation", "graph_features", "pagerank_n_all", "ppr_bad_n_all"])
def test_every_node_is_in(spark, sf_dir, pairs, name):
    assert sorted(r.node for r in catalog.QUERIES[name](spark, sf_dir).select("node").collect()) == sorted({x for p in pairs for x in p})


def iterated(rows, personal=None, directed=True):
    """Ranks of (src, dst, weight, seq) by plain iteration until nothing moves."""
    w = {}
    for a, b, x, q in sorted(rows, key=lambda r: r[3]):
        w[a, b] = float(x)
    if not directed:
        w = {k: max(w.get(k, 0), w.get(k[::-1], 0)) for k in {*w, *(k[::-1] for k in w)}}
    nodes = sorted({x for k in w for x in k})
    start = {n: float(n in personal) if personal else 1.0 for n in nodes}
    start = {n: v / sum(start.values()) for n, v in start.items()}
    out = {}
    for (a, _), x in w.items():
        out[a] = out.get(a, 0) + x
    rank = dict(start)
    for _ in range(400):
        lost = sum(v for n, v in rank.items() if n not in out)
        new = {n: 0.85 * lost * start[n] + 0.15 * start[n] for n in nodes}
        for (a, b), x in w.items():
            new[b] += 0.85 * rank[a] * x / out[a]
        rank = new
    return rank


@pytest.mark.parametrize("name,personal,directed", [("pagerank_n_all", None, True), ("ppr_bad_n_all", {"n1", "n2", "n3"}, False)])
def test_ranks_over_all_transfers_equal_plain_iteration(spark, sf_dir, name, personal, directed):
    rows = [(r.src, r.dst, r.amount_minor, r.seq) for r in T.edges(spark, sf_dir).collect()]
    want = iterated(rows, personal, directed)
    got = {r.node: r["rank"] for r in catalog.QUERIES[name](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and sum(abs(got[n] - want[n]) for n in want) < 1e-3 and sum(got.values()) == pytest.approx(1)
    top = lambda x: sorted(x, key=lambda n: -x[n])[:10]
    assert top(got) == top(want)


def test_taint_against_a_replay_unit_by_unit(spark, sf_dir):
    """Every unit of value stands for itself: a queue of (amount, taint) runs is replayed over all transfers in one go."""
    rows = sorted((r.seq, r.src, r.dst, r.amount_minor) for r in T.edges(spark, sf_dir).collect())
    held, flow, bad = {}, {}, {"n1", "n2", "n3"}
    for _, a, b, value in rows:
        sent = value if a in bad else 0
        left, queue = (0, []) if a in bad else (value, held.setdefault(a, []))
        while left and queue:
            have, dirty = queue.pop(0)
            take = min(have, left)
            part = dirty if take == have else dirty * take // have
            sent, left = sent + part, left - take
            if take < have:
                queue.insert(0, (have - take, dirty - part))
        held.setdefault(b, []).append((value, sent))
        f = flow.setdefault(b, [0, 0])
        f[a not in bad] += sent
    want = {x: (sum(v for v, _ in q), sum(t for _, t in q), *flow.get(x, [0, 0])) for x, q in held.items()}
    got = {r.address: (r.held, r.tainted, r.direct, r.indirect) for r in catalog.QUERIES["taint_exposure"](spark, sf_dir).collect()}
    assert {x: v for x, v in want.items() if x in got} == got and all(not any(v) for x, v in want.items() if x not in got)
