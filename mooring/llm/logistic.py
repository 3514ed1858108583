"""Logistic regression over hashed features, trained on the driver on a bounded sample."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np

#: Size of the hashed weight table; feature names are hashed into it.
WIDTH = 1 << 16


class Hashed:
    """Sparse binary features by name, hashed once each and remembered."""

    def __init__(self, width: int = WIDTH, remember: int = 200_000):
        self.width, self.seen, self.most = width, {}, remember

    def index(self, name: str) -> int:
        i = self.seen.get(name)
        if i is None:
            i = zlib.crc32(name.encode("utf-8", "surrogatepass")) % (self.width - 1) + 1
            if len(self.seen) < self.most:
                self.seen[name] = i
        return i

    def matrix(self, rows: Sequence[Sequence[str]]) -> np.ndarray:
        """Row indices padded with 0, the index whose weight stays 0."""
        out = np.zeros((len(rows), max(map(len, rows), default=1) or 1), dtype=np.int32)
        for i, r in enumerate(rows):
            out[i, : len(r)] = [self.index(x) for x in r]
        return out


def train(x: np.ndarray, y: np.ndarray, width: int = WIDTH, epochs: int = 12, rate: float = 0.2, l2: float = 1e-6, batch: int = 512, seed: int = 0, balanced: bool = False) -> np.ndarray:
    """Weights (the last is the bias) by AdaGrad over shuffled batches.

    ``balanced``: both classes count alike, however many rows they have.
    """
    ones = float(y.sum())
    weight = np.where(y > 0.5, 0.5 * len(y) / max(1.0, ones), 0.5 * len(y) / max(1.0, len(y) - ones)) if balanced else np.ones(len(y))
    w, g2 = np.zeros(width + 1), np.full(width + 1, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            xi, yi = x[rows], y[rows]
            err = 1 / (1 + np.exp(-np.clip(w[xi].sum(1) + w[-1], -30, 30))) - yi
            err *= weight[rows]
            g = np.bincount(xi.ravel(), np.repeat(err, xi.shape[1]), width + 1) / len(rows) + l2 * w
            g[-1] = err.mean()
            g[0] = 0
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
            w[0] = 0
    return w


def score(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[x].sum(1) + w[-1], -30, 30)))
