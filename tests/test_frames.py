"""Windows over sorted batches beside plain counting, however the batches are cut; their growth."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fraudloom.operators import frames
from fraudloom.operators import windows as W

COLS = pa.schema([("id", "int64"), ("k", "string"), ("_chunk", "int64"), ("us", "int64"), ("amount_minor", "int64"), ("declined", "bool"), ("device", "string"), ("_own", "bool")])


def got(rows, batch, horizons, arrival, lag):
    t = pa.Table.from_pylist([dict(zip(COLS.names, r)) for r in rows], COLS)
    return [tuple(x.values()) for b in frames.stream(iter(t.to_batches(max_chunksize=batch)), "k", ["id"], horizons, arrival, lag) for x in b.to_pylist()]


def want(rows, horizons, arrival, lag):
    out, before = [], {}
    for j, r in enumerate(rows):
        line = []
        for e in horizons.values():
            h = [x for i, x in enumerate(rows) if x[1:3] == r[1:3] and (x[3] is None) == (r[3] is None) and (i <= j if arrival or r[3] is None and i <= j else r[3] is None or x[3] <= r[3]) and (r[3] is None or r[3] - x[3] <= e)]
            a = [x[4] or 0 for x in h]
            line += [len(h), sum(a), sum(x * x for x in a), sum(bool(x[5]) for x in h), len({x[6] for x in h} - {None})]
        out.append((r[0], *(before.get(r[1:3], [None] * len(line)) if lag else line)))
        before[r[1:3]] = line
    return [x for x, r in zip(out, rows) if r[7]]


@pytest.mark.parametrize("arrival", [False, True])
@pytest.mark.parametrize("lag", [False, True])
@pytest.mark.parametrize("batch", [1, 7, 1_000])
def test_against_plain_counting(monkeypatch, arrival, lag, batch):
    """Null keys, times, amounts and devices, ties, amounts whose squares pass 64 bits, keys in several chunks."""
    r = random.Random(batch)
    monkeypatch.setattr(frames, "LEAST", 5)
    monkeypatch.setattr(frames, "MOST", 20)
    horizons = {"a": 3, "b": 40}
    rows = [(0, r.choice([None, "x", "y", "z"]), r.choice([0, 0, 1]), r.choice([None, *range(90)]), r.choice([None, 5, 700, -4_000_000_000]), r.choice([None, True, False]), r.choice([None, "d", "e", "f"]), r.random() < 0.8) for _ in range(160)]
    rows = sorted(rows, key=lambda x: (x[1] is not None, x[1] or "", x[2], -1 if x[3] is None else x[3]))
    rows = [(k, *x[1:]) for k, x in enumerate(rows)]
    assert got(rows, batch, horizons, arrival, lag) == want(rows, horizons, arrival, lag)


def test_groups_beyond_64_bits_are_halved():
    us = np.array([0, 2**60, 0, 2**60, 5], np.int64)
    x = frames.windows_of(np.array([0, 0, 1, 1, 2]), us, us * 0 + 1, us * 0, us * 0, [2**60 + 1], False)
    assert [list(map(int, v)) for v in x] == [[1, 2, 1, 2, 1]] * 3 + [[0] * 5, [1] * 5]


def test_many_cards_with_many_events_take_linear_work(spark):
    """600,000 events of 200 cards, 3,000 each, all in one horizon: totals over all moments did not end in a minute for a million."""
    d = spark.range(600_000).select(F.col("id").alias("txn_id"), (F.col("id") % 200).cast("string").alias("card_token"), (F.lit(10**15) + F.col("id") * 1_000).alias("us"), F.lit(7).cast("long").alias("amount_minor"), (F.col("id") % 50).cast("string").alias("device"), (F.col("id") % 400 == 0).alias("declined"))
    start = time.monotonic()
    r = W.lagged(d).agg(F.sum("cnt_30d"), F.sum("dec_30d"), F.sum(F.col("cnt_1m").isNull().cast("int")), F.max("sq_30d")).first()
    assert (r[0], r[2], int(r[3])) == (200 * 2_999 * 3_000 // 2, 200, 2_999 * 49) and time.monotonic() - start < 40


@pytest.mark.parametrize("ties", ["peers", "arrival"])
def test_busy_keys_are_cut_in_time(spark, monkeypatch, ties):
    r = random.Random(2)
    rows = [(k, r.choice(["a", None]), None if r.random() < 0.05 else 10**15 + r.randrange(10**13) // 10**10 * 10**10, r.choice([1, 2]), r.choice(["d", "e", None]), r.random() < 0.5) for k in range(300)]
    d = spark.createDataFrame(rows, "txn_id long, card_token string, us long, amount_minor long, device string, declined boolean")
    both = []
    for limit in (0, 10**9):
        monkeypatch.setattr(W, "BUSY", limit)
        both.append(sorted((tuple(x) for x in W.six_windows(d, "card_token", ties=ties).collect()), key=lambda x: x[0]))
    assert both[0] == both[1] and len(both[0]) == 300
