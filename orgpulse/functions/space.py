"""Splitting three-dimensional points into balanced boxes, and nearest neighbours inside a box.

Small numpy helpers used inside Spark tasks. The cell tree is built from a bounded sample and only
balances the work; which box a point belongs to and how far boxes are is computed exactly.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

# Executors get these helpers inside the task itself and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cells of a distance block held in memory at once.
_BLOCK = 2_000_000


@dataclass(frozen=True)
class CellTree:
    """Complete binary tree of axis cuts in heap order; leaves are numbered left to right."""

    axis: np.ndarray
    cut: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.axis) + 1

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        inner = len(self.axis)
        rows = np.arange(len(points))
        while inner and node.size and node[0] < inner:
            right = points[rows, self.axis[node]] > self.cut[node]
            node = 2 * node + 1 + right
        return node - inner


def _cut(points: np.ndarray) -> tuple[int, float]:
    """Axis and value of the best cut: balanced first, then the widest axis."""
    options = []
    for a in range(points.shape[1]):
        v = points[:, a]
        if not len(v):
            continue
        at = float(np.median(v))
        if at == v.max():
            lower = v[v < at]
            if not len(lower):
                continue
            at = float(lower.max())
        lean = abs(float(np.mean(v > at)) - 0.5)
        options.append((lean > 0.15, lean if lean > 0.15 else -float(np.ptp(v)), a, at))
    if not options:
        return 0, float(points[0, 0]) if len(points) else 0.0
    _, _, a, at = min(options)
    return a, at


def build_tree(sample: np.ndarray, depth: int) -> CellTree:
    inner = 2**depth - 1
    axis, cut = np.zeros(inner, dtype=np.int64), np.zeros(inner)
    parts = [sample]
    for node in range(inner):
        points = parts[node]
        axis[node], cut[node] = _cut(points)
        right = points[:, axis[node]] > cut[node]
        parts += [points[~right], points[right]]
        parts[node] = None
    return CellTree(axis, cut)


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance of every point to every box (0 inside), one row per point."""
    gap = np.maximum(low[None, :, :] - points[:, None, :], points[:, None, :] - high[None, :, :])
    return np.sqrt((np.maximum(gap, 0.0) ** 2).sum(axis=2))


def nearest(queries: np.ndarray, points: np.ndarray, k: int, limit: np.ndarray | None = None):
    """For each query its `k` nearest points as (query index, point index, distance) triples.

    Equal distances are resolved by the order of `points`; `limit` drops points farther away.
    """
    step = max(1, _BLOCK // max(1, len(points)))
    found = []
    for start in range(0, len(queries), step):
        q = queries[start : start + step]
        sq = np.zeros((len(q), len(points)))
        for a in range(3):
            sq += (q[:, None, a] - points[None, :, a]) ** 2
        dist = np.sqrt(sq)
        keep = np.ones_like(dist, dtype=bool)
        if len(points) > k:
            keep = dist <= np.partition(dist, k - 1, axis=1)[:, k - 1 : k]
        if limit is not None:
            keep &= dist <= limit[start : start + step, None]
        i, j = np.nonzero(keep)
        d = dist[i, j]
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.searchsorted(i, i, side="left")
        top = np.arange(len(i)) - first < k
        found.append((i[top] + start, j[top], d[top]))
    if not found:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found))
