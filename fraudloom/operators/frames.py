"""Sliding windows over sorted Arrow batches: running sums and places in flat arrays, linear in the rows whatever a window holds."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa

PARTS = ("cnt", "sum", "sq", "dec", "dev")
#: Rows taken together, at least and at most; in between, as many as windows still reach back to.
LEAST, MOST = 50_000, 400_000


def _between(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    run = np.zeros(len(x) + 1, x.dtype)
    np.cumsum(x, out=run[1:])
    return run[hi] - run[lo]


def _exact(x: np.ndarray, power: int) -> np.ndarray:
    """x to the power as whole numbers whose sums are exact: Python's where 64 bits may not do."""
    top = max(-int(x.min()), int(x.max())) if len(x) else 0
    return x**power if top**power * len(x) < 2**63 else x.astype(object) ** power


def windows_of(group: np.ndarray, us: np.ndarray, amount: np.ndarray, declined: np.ndarray, device: np.ndarray, edges: list[int], arrival: bool) -> list[np.ndarray]:
    """Rows sorted by group (0, 1, 2 ...) and us -> PARTS of each horizon, one after another; device codes, -1 for none.

    A row's window is all places from the first that is no older than the edge
    to itself, or with its peers. A device counts from each row of it to the
    next one or until that row is too old, whichever is first.
    """
    n, wide = len(us), max(edges) + 1
    since = us - us.min()
    stride = int(since.max()) + 2 * wide
    at_once = max(1, (2**62) // stride)
    if int(group[-1]) >= at_once:
        cut = int(np.searchsorted(group, group[0] + at_once))
        if cut < n:
            halves = [windows_of(g - g[0], *x, edges, arrival) for s in (slice(0, cut), slice(cut, n)) for g, *x in [(group[s], us[s], amount[s], declined[s], device[s])]]
            return [np.concatenate(x) for x in zip(*halves)]
    c = (group - group[0]) * stride + since
    hi = np.arange(1, n + 1) if arrival else np.searchsorted(c, c, "right")
    has = device >= 0
    pair = group * (int(device.max()) + 2) + device
    order = np.argsort(pair, kind="stable")
    again = (pair[order[1:]] == pair[order[:-1]]) & has[order[1:]]
    upcoming = np.full(n, n)
    upcoming[order[:-1][again]] = order[1:][again]
    known = np.concatenate([[0], np.cumsum(has)])[hi]
    sums, squares = _exact(amount, 1), _exact(amount, 2)
    out = []
    for edge in edges:
        lo = np.searchsorted(c, c - edge)
        gone = np.minimum(upcoming, np.searchsorted(c, c + edge, "right"))[has]
        out += [hi - lo, _between(sums, lo, hi), _between(squares, lo, hi), _between(declined, lo, hi), known - np.cumsum(np.bincount(gone, minlength=n + 1))[hi - 1]]
    return out


def _column(x: np.ndarray, kind: pa.DataType, null: np.ndarray | None) -> pa.Array:
    if x.dtype == object:
        if not pa.types.is_decimal(kind):
            return pa.array([None if null is not None and null[k] else int(v) for k, v in enumerate(x)], kind)
        return pa.array([None if null is not None and null[k] else Decimal(int(v)) for k, v in enumerate(x)], kind)
    return pa.array(x, pa.int64(), mask=null).cast(kind)


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t[name].combine_chunks().cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def stream(batches: Iterator[pa.RecordBatch], key: str, keep: list[str], horizons: dict[str, int], arrival: bool, lag: bool) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (key, _chunk, us, seq) -> their own rows' columns `keep` and the windows; with lag those that the key's row before left.

    What the last rows' windows still reach is carried over to the next
    batches; peers of the last moment wait for the rest of them.
    """
    edges, wide = list(horizons.values()), max(horizons.values()) + 1
    kinds = [pa.decimal128(38, 0) if p == "sq" else pa.int64() for _ in edges for p in PARTS]
    names = [f"{p}_{h}" for h in horizons for p in PARTS]
    carried: dict | None = None

    def done(t: pa.Table, final: bool) -> tuple[pa.Table, list[pa.RecordBatch]]:
        nonlocal carried
        k, codes = t[key].combine_chunks(), None
        codes = k.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        chunk, us = t["_chunk"].combine_chunks(), t["us"].combine_chunks()
        none = us.is_null().to_numpy(zero_copy_only=False)
        known = us.drop_null()
        at = us.fill_null(known[0] if len(known) else 0).to_numpy(zero_copy_only=False)
        cuts = _numbers(t, "_chunk")
        fresh = np.concatenate([[True], (codes[1:] != codes[:-1]) | (cuts[1:] != cuts[:-1])])
        new = fresh | np.concatenate([[True], none[1:] != none[:-1]])
        n = len(at)
        if not final and not arrival:
            last = np.flatnonzero(new | np.concatenate([[True], at[1:] != at[:-1]]))[-1]
            n = int(last)
            if not n:
                return t, []
        rest, t = t.slice(n), t.slice(0, n)
        new, fresh, none, at = new[:n], fresh[:n], none[:n], at[:n]
        row = [k[0].as_py(), chunk[0].as_py()]
        same_key = carried is not None and carried["key"] == row
        old = carried if same_key and carried["none"] == bool(none[0]) else None
        group = np.cumsum(new) - 1
        mine = [group, at, _numbers(t, "amount_minor"), _numbers(t, "declined")]
        device = t["device"].combine_chunks()
        back = 0
        if old is not None:
            back = len(old["rows"][0])
            mine = [np.concatenate(x) for x in zip([np.zeros(back, np.int64), *old["rows"]], mine)]
            device = pa.concat_arrays([old["device"], device])
        found = windows_of(*mine, device.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), edges, arrival)
        found = [x[back:] for x in found]
        ends = [x[-1:] for x in found]
        null = None
        if lag:
            null = fresh.copy()
            null[0] = not same_key
            before = carried["ends"] if same_key else [np.zeros(1, np.int64)] * len(found)
            found = [np.concatenate([b, x[:-1]]) for b, x in zip(before, found)]
        group, at = mine[0], mine[1]
        stays = (group == group[-1]) & (at >= at[-1] - wide)
        carried = {"key": [k[n - 1].as_py(), chunk[n - 1].as_py()], "none": bool(none[-1]), "rows": [x[stays] for x in mine[1:]], "device": device.filter(pa.array(stays)), "ends": ends}
        out = pa.table([*[t[c] for c in keep], *[_column(x, kind, null) for x, kind in zip(found, kinds)]], names=[*keep, *names])
        return rest, out.filter(t["_own"]).combine_chunks().to_batches(max_chunksize=50_000)

    pending, rows = [], 0
    for b in batches:
        pending.append(b)
        rows += b.num_rows
        if rows >= min(MOST, max(LEAST, len(carried["rows"][0]) if carried else 0)):
            rest, out = done(pa.Table.from_batches(pending), False)
            yield from out
            pending, rows = rest.to_batches(), 0  # what waits is counted only with more beside it
    if pending and (t := pa.Table.from_batches(pending)).num_rows:
        yield from done(t, True)[1]
