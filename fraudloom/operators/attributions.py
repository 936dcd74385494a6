"""Exact Shapley values of tree ensembles in polynomial time, vectorised over rows and leaves.

A leaf speaks through the features on its path. With each of them known, the
row either stays on the path (o, 1 or 0); unknown, a share z of the training
rows does. A coalition's value at the leaf is the product of these, so the
product of (z + o y) over the path holds in the coefficient of y^s the sum over
all coalitions of s features. Dividing one feature's factor out again gives its
Shapley value by weighing s known others with s!(m-1-s)!/m!: steps in the
square of the path's length instead of a subset of the features each.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np


@dataclass
class Paths:
    """The leaves of one tree: per leaf and place on its path (filled up with places that change nothing) feature, interval (low, high] and share z."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    z: np.ndarray
    value: np.ndarray
    table: np.ndarray | None = None
    whose: np.ndarray | None = None

    @classmethod
    def of(cls, nodes: list[dict], weight: float = 1.0) -> Paths:
        leaves: list[tuple[dict, float]] = []
        todo: list[tuple[int, dict]] = [(0, {})]
        while todo:
            k, path = todo.pop()
            n = nodes[k]
            if "feature" not in n:
                leaves.append((path, n["value"]))
                continue
            f, both = n["feature"], nodes[n["left"]]["rows"] + nodes[n["right"]]["rows"]
            low, high, z = path.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in ((n["left"], (low, min(high, n["threshold"]))), (n["right"], (max(low, n["threshold"]), high))):
                todo.append((child, path | {f: (*bounds, z * nodes[child]["rows"] / both)}))
        m = max((len(p) for p, _ in leaves), default=0)
        shape = (len(leaves), m)
        feature, low, high, z = np.zeros(shape, np.int64), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape)
        for k, (p, _) in enumerate(leaves):
            for j, (f, (a, b, s)) in enumerate(sorted(p.items())):
                feature[k, j], low[k, j], high[k, j], z[k, j] = f, a, b, s
        return cls(feature, low, high, z, weight * np.array([v for _, v in leaves]))

    def mean(self) -> float:
        """The tree's expectation with nothing known."""
        return float((self.value * self.z.prod(axis=1)).sum())

    def shares(self, on: np.ndarray) -> np.ndarray:
        """on (leaf, place, row): whether a row stays on the path -> each place's value at a leaf that is worth 1."""
        leaves, m, n = on.shape
        z = self.z[:, :, None]
        product = np.zeros((m + 1, leaves, n))
        product[0] = 1.0
        for j in range(m):
            product[1 : j + 2] = product[1 : j + 2] * z[:, j] + product[: j + 1] * on[:, j]
            product[0] *= z[:, j]
        weigh = [factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)]
        each = np.empty(on.shape)
        for j in range(m):
            rest = np.zeros((leaves, n))  # the others' coefficient of y^s, from the highest down where the row is on the path
            total, known = np.zeros((leaves, n)), on[:, j]
            unknown = np.where(z[:, j] > 0, 1 / np.maximum(z[:, j], 1e-300), 1.0)
            for s in range(m - 1, -1, -1):
                rest = product[s + 1] - z[:, j] * rest
                total += np.where(known, rest, product[s] * unknown) * weigh[s]
            each[:, j] = (known - z[:, j]) * total
        return each

    def add(self, x: np.ndarray, out: np.ndarray) -> None:
        """Adds the tree's values of rows x to out (rows by features)."""
        leaves, m = self.feature.shape
        if not m:
            return
        seen = x.T[self.feature]  # leaf, place, row
        on = (seen > self.low[:, :, None]) & (seen <= self.high[:, :, None])
        if m <= SHORT:  # few ways of being on a path: looked up, computed once
            if self.table is None:
                ways = (np.arange(1 << m) >> np.arange(m)[:, None] & 1).astype(bool)
                self.table = np.ascontiguousarray(self.shares(np.broadcast_to(ways, (leaves, m, 1 << m))).transpose(0, 2, 1)) * self.value[:, None, None]
                self.whose = (np.arange(x.shape[1])[None, :] == self.feature.reshape(-1)[:, None]).astype(float)
            way = np.einsum("lmn,m->nl", on, 1 << np.arange(m))
            out += self.table[np.arange(leaves), way].reshape(len(x), -1) @ self.whose
            return
        each = self.shares(on) * self.value[:, None, None]
        whose = np.arange(x.shape[1])[:, None] == self.feature.reshape(-1)
        out += (whose @ each.reshape(-1, len(x))).T


#: Places on a path up to which its values are kept by the set of places that a row is on.
SHORT = 8
#: Rows times leaves that are computed together: what fits a processor's cache.
CELLS = 10_000


def shapley(paths: list[Paths], x: np.ndarray) -> np.ndarray:
    """Rows x (rows by features) -> their values; with the trees' means they add up to the ensemble's output."""
    out = np.zeros(x.shape)
    for p in paths:
        step = max(1, CELLS // max(1, len(p.value)))
        for k in range(0, len(x), step):
            p.add(x[k : k + step], out[k : k + step])
    return out
