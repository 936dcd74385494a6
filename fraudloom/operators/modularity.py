"""Greedy modularity of one weak component: numbers in flat arrays, work about linear in its links."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace
from itertools import chain

import numpy as np

LOW, STEP = (1 << 32) - 1, 1 << 18


def _pieces(x: np.ndarray) -> Iterator[np.ndarray]:
    """Views of x, so that what is made of it in passing stays small."""
    return (x[k : k + STEP] for k in range(0, len(x), STEP))


def _grouped(of: np.ndarray, what: np.ndarray, n: int, named: np.ndarray | None = None) -> tuple[array, list[int]]:
    """`what` ordered by (of, what), or what it names, and where each one's begin."""
    key = of.astype(np.int64)
    key <<= 32
    key |= what
    key.sort()
    at, out = np.searchsorted(key, np.arange(n + 1, dtype=np.int64) << 32), array("i")
    for x in _pieces(key):
        x &= LOW
        out.frombytes((x if named is None else named[x]).astype(np.int32).view(np.uint8))
    return out, at.tolist()


class Merges:
    """The merge with the largest gain until each one loses; gains are whole numbers (2 * m^2 times the modularity's).

    Ties go to the smaller pair of labels; a node's number is its label and
    the larger label stays. A link stands in the row of its end with fewer
    links and waits at the other, the owner, with those of as many links
    (class), least degree first: the order inside a class is the same
    whatever the owner's degree, so one entry a class is in the heap. Gains only
    fall and labels only grow until a link's number changes, so an entry is a
    bound, looked at again when it comes up; what changes its number is
    entered anew. Links that lose wait for that. Rows and waiting lists are
    sorted slices of flat arrays; a merge changes rows in their place, and only
    one that outgrows it becomes a dict. What a node that is gone held goes
    with it. What waits is one number: degree, label, node. a and b (int32)
    are overwritten.
    """

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, m: int):
        self.m2 = 2 * m
        first = np.bincount(a, minlength=n)
        first += np.bincount(b, minlength=n)
        if (k := np.count_nonzero(apart := a != b)) < len(a):
            for end in (a, b):
                end[:k] = end[apart]
            a, b = a[:k], b[:k]
        del apart
        order = np.argsort(first, kind="stable").astype(np.int32)
        rank = np.empty(n, np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        for owner, other in zip(_pieces(a), _pieces(b)):
            up = rank[owner] < rank[other]
            owner[up], other[up] = other[up], owner[up]
        self.row, self.row_at = _grouped(b, a, n)
        self.many, self.row_end = array("i", [1]) * len(self.row), self.row_at[1:]
        for other in _pieces(b):
            other[:] = rank[other]
        self.wait, self.wait_at = _grouped(a, b, n, order)
        self.first = first.tolist()
        self.deg, self.label, self.alive, self.cursor = first.tolist(), list(range(n)), bytearray(b"\1") * n, self.wait_at[:n]
        self.rows: dict[int, dict[int, int]] = {}
        self.more: dict[int, array] = {}
        self.classes: dict[int, dict[int, list[int]]] = {}
        self.best: dict[tuple[int, int], tuple] = {}
        self.heap: list[tuple] = []
        self.into: list[tuple[int, int]] = []

    def _place(self, z: int, y: int) -> tuple[int, bool]:
        """Where y is, or belongs, in the slice of z; whether it is there."""
        end = self.row_end[z]
        k = bisect_left(self.row, y, self.row_at[z], end)
        return k, k < end and self.row[k] == y

    def _in_row(self, z: int, y: int) -> int:
        if (r := self.rows.get(z)) is not None:
            return r.get(y, 0)
        k, there = self._place(z, y)
        return self.many[k] if there else 0

    def _take(self, z: int, y: int) -> int:
        """The links from z's row to y, which leave it; 0 if there are none."""
        if (r := self.rows.get(z)) is not None:
            return r.pop(y, 0)
        k, there = self._place(z, y)
        if not there:
            return 0
        n, end = self.many[k], self.row_end[z]
        for x in (self.row, self.many):
            x[k : end - 1] = x[k + 1 : end]
        self.row_end[z] = end - 1
        return n

    def _put(self, z: int, y: int, n: int) -> None:
        """y with n links in z's row."""
        if (r := self.rows.get(z)) is not None:
            r[y] = n
            return
        k, there = self._place(z, y)
        if there:
            self.many[k] = n
        elif (end := self.row_end[z]) < self.row_at[z + 1]:
            for x, v in ((self.row, y), (self.many, n)):
                x[k + 1 : end + 1] = x[k:end]
                x[k] = v
            self.row_end[z] = end + 1
        else:
            self.rows[z] = self._all(z)
            self.rows[z][y] = n

    def _all(self, z: int) -> dict[int, int]:
        s = slice(self.row_at[z], self.row_end[z])
        return dict(zip(self.row[s], self.many[s]))

    def between(self, y: int, z: int) -> int:
        return self._in_row(z, y) or self._in_row(y, z)

    def _key(self, y: int, n: int, at: int) -> tuple:
        d, k, own = at >> 64, at >> 32 & LOW, self.label[y]
        return (self.deg[y] * d - self.m2 * n, *((k, own) if k < own else (own, k)), y, n)

    def _at(self, z: int) -> int:
        return self.deg[z] << 64 | self.label[z] << 32 | z

    def _push(self, y: int, n: int, at: int) -> None:
        heappush(self.classes.setdefault(y, {}).setdefault(n, []), at)

    def top(self, y: int, n: int) -> int | None:
        """The best that waits at y with n links."""
        deg, label, alive, h = self.deg, self.label, self.alive, self.classes.get(y, {}).get(n)
        while h:
            z = h[0] & LOW
            if not alive[z] or self.between(y, z) != n:
                heappop(h)
            elif h[0] != (at := self._at(z)):
                heapreplace(h, at)
            else:
                break
        best = h[0] if h else None
        if n > 1:
            return best
        p, end = self.cursor[y], self.wait_at[y + 1]
        while p < end:
            z = self.wait[p]
            if alive[z] and self.between(y, z) == 1:
                at = self._at(z)
                best = at if best is None else min(best, at)
                if deg[z] == self.first[z] and label[z] == z:
                    break
                self._push(y, 1, at)
            p += 1
        self.cursor[y] = p
        return best

    def enter(self, y: int, n: int, at: int | None) -> None:
        if at is not None and (key := self._key(y, n, at))[0] <= 0 and ((now := self.best.get((y, n))) is None or key < now):
            self.best[y, n] = key
            heappush(self.heap, key)

    def merge(self, x: int, y: int) -> None:
        size = lambda z: self.row_end[z] - self.row_at[z] + self.wait_at[z + 1] - self.wait_at[z] + len(self.rows.get(z, ())) + len(self.more.get(z, ()))
        if size(x) > size(y):
            x, y = y, x
        deg, label, alive = self.deg, self.label, self.alive
        if (moved := self.rows.pop(x, None)) is None:
            moved = self._all(x)
        for z in chain(self.wait[self.wait_at[x] : self.wait_at[x + 1]], self.more.pop(x, ())):
            if alive[z] and z != x and (n := self._take(z, x)):
                moved[z] = n
        moved.pop(y, None)
        alive[x] = 0
        self.classes.pop(x, None)
        self.into.append((x, y))
        deg[y] += deg[x]
        label[y] = max(label[x], label[y])
        dy = deg[y]
        self._take(y, x)
        for z, n in moved.items():
            if was := self._in_row(z, y):
                n += was
                self._put(z, y, n)
            elif was := self._in_row(y, z):
                n += was
                self._put(y, z, n)
            elif dy > deg[z]:
                self._put(z, y, n)
                self.more.setdefault(y, array("i")).append(z)
            else:
                self._put(y, z, n)
                self.more.setdefault(z, array("i")).append(y)
            if dy * deg[z] <= self.m2 * n:
                o, s = (y, z) if dy > deg[z] else (z, y)
                at = self._at(s)
                self._push(o, n, at)
                self.enter(o, n, at)

    def run(self) -> np.ndarray:
        """A node of its community for each node."""
        for y in range(len(self.deg)):
            if self.wait_at[y] < self.wait_at[y + 1]:
                self.enter(y, 1, self.top(y, 1))
        heapify(self.heap)
        while self.heap:
            key = heappop(self.heap)
            y, n = key[3:]
            if self.best.get((y, n)) != key:
                continue
            del self.best[y, n]
            if not self.alive[y]:
                continue
            at = self.top(y, n)
            if at is not None and self._key(y, n, at) == key:
                self.merge(at & LOW, y)
                if not self.alive[y]:
                    continue
                at = self.top(y, n)
            self.enter(y, n, at)
        root = np.arange(len(self.deg))
        for x, y in reversed(self.into):
            root[x] = root[y]
        return root


def communities_of(a: np.ndarray, b: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b) of one component of a graph with m links -> each node, the first of its community and that one's size.

    a and b (int32) are overwritten: no second copy of the pairs is made.
    """
    ids = np.unique(np.concatenate([np.unique(x) for end in (a, b) for x in _pieces(end)]))
    for end in (a, b):
        for x in _pieces(end):
            x[:] = np.searchsorted(ids, x)
    root = Merges(len(ids), a, b, m).run()
    _, first, which, size = np.unique(root, return_index=True, return_inverse=True, return_counts=True)
    return ids, ids[first][which], size[which]


def by_component(batches: Iterator, m: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Arrow batches (component, a, b) sorted by component -> component and communities_of() it, one after another."""
    at, held = None, (array("i"), array("i"))
    for batch in batches:
        c, a, b = (batch.column(k).to_numpy() for k in range(3))
        cuts = [0, *(np.flatnonzero(np.diff(c)) + 1).tolist(), len(c)] if len(c) else [0]
        for lo, hi in zip(cuts, cuts[1:]):
            if c[lo] != at:
                if held[0]:
                    yield at, *communities_of(*(np.frombuffer(x, np.int32) for x in held), m)
                at, held = c[lo], (array("i"), array("i"))
            for end, x in zip(held, (a, b)):
                end.frombytes(x[lo:hi].astype(np.int32).view(np.uint8))
    if held[0]:
        yield at, *communities_of(*(np.frombuffer(x, np.int32) for x in held), m)
