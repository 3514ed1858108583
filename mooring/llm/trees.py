"""Gradient-boosted regression trees in numpy.

Trained on the driver on a bounded sample (histogram splits over quantile bins,
squared error), flattened into node arrays and scored for all rows and trees at
once. A feature may be monotonic: a split on it that would lower the prediction
on its high side (for +1) is not made, and the values of the two sides are kept
apart by bounds passed down the tree.
"""

from __future__ import annotations

import numpy as np


class Forest:
    """Flattened trees: every array is ``(trees, nodes)``; a leaf points to itself."""

    def __init__(self, feature, threshold, left, right, value, depth: int, base: float):
        self.feature, self.threshold, self.left, self.right, self.value, self.depth, self.base = feature, threshold, left, right, value, depth, base

    def predict(self, x: np.ndarray) -> np.ndarray:
        n, t = len(x), len(self.feature)
        out = np.full(n, self.base)
        if not n or not t:
            return out
        trees = np.arange(t)[None, :]
        rows = np.arange(n)[:, None]
        at = np.zeros((n, t), np.int32)
        for _ in range(self.depth):
            go = x[rows, self.feature[trees, at]] > self.threshold[trees, at]
            at = np.where(go, self.right[trees, at], self.left[trees, at])
        return out + self.value[trees, at].sum(1)


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 8, l2: float = 1.0) -> Forest:
    """A forest for ``y``; ``monotone`` has 1, 0 or -1 for each feature."""
    n, f = x.shape if x.size else (0, len(monotone))
    nodes = 2 ** (depth + 1) - 1
    shape = (trees if n else 0, nodes)
    feature, threshold, value = np.zeros(shape, np.int32), np.full(shape, np.inf), np.zeros(shape)
    left = np.tile(np.arange(nodes, dtype=np.int32), (shape[0], 1))
    right = left.copy()
    if not n:
        return Forest(feature, threshold, left, right, value, depth, 0.0)
    base = float(y.mean())
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(f)], 1)
    pred = np.full(n, base)
    for t in range(trees):
        residual = y - pred
        stack = [(0, np.arange(n), 0, -np.inf, np.inf)]
        while stack:
            node, rows, level, low, high = stack.pop()
            g = residual[rows]
            own = float(np.clip(g.sum() / (len(g) + l2), low, high))
            value[t, node] = rate * own
            if level == depth or len(rows) < 2 * least:
                pred[rows] += value[t, node]
                continue
            best = (1e-9, None)
            whole = g.sum() ** 2 / (len(g) + l2)
            for j in range(f):
                if not len(cuts[j]):
                    continue
                k = len(cuts[j]) + 1
                c = np.bincount(code[rows, j], minlength=k).cumsum()[:-1]
                s = np.bincount(code[rows, j], weights=g, minlength=k).cumsum()[:-1]
                c2, s2 = len(g) - c, g.sum() - s
                a, b = s / (c + l2), s2 / (c2 + l2)
                gain = s * a + s2 * b - whole
                bad = (c < least) | (c2 < least) | (monotone[j] * (b - a) < 0)
                gain[bad] = -1
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], (j, i, a[i], b[i]))
            if best[1] is None:
                pred[rows] += value[t, node]
                continue
            j, i, a, b = best[1]
            feature[t, node], threshold[t, node] = j, cuts[j][i]
            left[t, node], right[t, node] = 2 * node + 1, 2 * node + 2
            middle = float(np.clip((a + b) / 2, low, high))
            bounds = ((low, middle), (middle, high)) if monotone[j] > 0 else ((middle, high), (low, middle)) if monotone[j] < 0 else ((low, high), (low, high))
            goes = code[rows, j] > i
            stack += [(2 * node + 1, rows[~goes], level + 1, *bounds[0]), (2 * node + 2, rows[goes], level + 1, *bounds[1])]
    return Forest(feature, threshold, left, right, value, depth, base)
