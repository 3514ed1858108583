"""Prediction by partial matching over bytes, frozen and scored with numpy.

Each class (language) has a variable-order context tree of bytes: contexts of
``ORDER`` bytes down to none, with escape probabilities (method C: a context seen
``n`` times with ``d`` different next bytes escapes with ``d / (n + d)``). After
training, the statistics are frozen, so the code length of a byte depends on
nothing but the bytes before it. That lets every length be worked out ahead:
for each context and next byte that any class has seen, the table holds the exact
code length in *all* classes; a byte is scored by one table look-up, and only
where no class knows the pair its escapes are added and the next shorter context
is tried.
"""

from __future__ import annotations

import numpy as np

#: Bytes of the longest context. Context and next byte are packed in 64 bits.
ORDER = 5
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """Packed ``order`` previous bytes and the byte itself, for each position; zero bytes before the start."""
    n = len(data)
    pad = np.concatenate([np.zeros(order, np.uint8), data]).astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(order + 1):
        out = (out << np.uint64(8)) | pad[i : i + n]
    return out


class _Index:
    """Open addressing over 64-bit keys, probed for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int32)
        self.keys = keys
        todo = np.arange(len(keys), dtype=np.int32)
        at = self._hash(keys)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]  # of several for one slot the last stays
            lost = self.slot[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it isn't."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._hash(keys)
        got = self.slot[at]
        open_ = np.flatnonzero((got >= 0) & (self.keys[got] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            s = self.slot[at[open_]]
            got[open_] = s
            open_ = open_[(s >= 0) & (self.keys[s] != keys[open_])]
        return got


class Model:
    """Frozen trees of several classes.

    ``texts[c]``: the training texts of class ``c``. Zero bytes stand before each.
    """

    def __init__(self, classes: list[str], texts: list[list[bytes]], order: int = ORDER):
        self.classes, self.order = list(classes), order
        n = len(classes)
        per = []  # per order: (gram keys, counts[n]), built from all classes
        for k in range(order + 1):
            keys, owner = [], []
            for c in range(n):
                data = [_grams(np.frombuffer(t, np.uint8), k) for t in texts[c] if t]
                if data:
                    keys.append(np.concatenate(data))
                    owner.append(np.full(len(keys[-1]), c))
            every = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            who = np.concatenate(owner) if owner else np.empty(0, np.int64)
            uniq, inv = np.unique(every, return_inverse=True)
            counts = np.bincount(inv * n + who, minlength=len(uniq) * n).reshape(-1, n)
            per.append((uniq, counts))
        self.gram, self.cost, self.ctx, self.escape = [], [], [], []
        for k, (grams, counts) in enumerate(per):
            ctx, inv = np.unique(grams >> np.uint64(8), return_inverse=True)
            total = np.zeros((len(ctx), n))
            kinds = np.zeros((len(ctx), n))
            np.add.at(total, inv, counts)
            np.add.at(kinds, inv, counts > 0)
            known = total > 0
            escape = np.where(known, -np.log2(np.where(known, kinds / np.maximum(total + kinds, 1), 1)), 0)
            lower = self._code(grams, k - 1) if len(grams) else np.zeros((0, n))
            with np.errstate(divide="ignore"):
                own = -np.log2(counts / np.maximum(total + kinds, 1)[inv])
            self.cost.append(np.where(counts > 0, own, escape[inv] + lower).astype(np.float32))
            self.gram.append(_Index(grams))
            self.ctx.append(_Index(ctx))
            self.escape.append(escape.astype(np.float32))

    def _code(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Code length in each class of the last byte of ``grams``, tried from order ``k`` down."""
        n = len(self.classes)
        if k < 0 or not len(self.gram[k].keys):
            out, todo = np.zeros((len(grams), n), np.float32), np.arange(len(grams))
        else:  # most bytes are known to the longest context: those are one gather
            at = self.gram[k].find(grams & np.uint64((1 << (8 * (k + 1))) - 1))
            todo = np.flatnonzero(at < 0)
            at[todo] = 0
            out = self.cost[k].take(at, axis=0)
            c = self.ctx[k].find((grams[todo] & np.uint64((1 << (8 * (k + 1))) - 1)) >> np.uint64(8))
            out[todo] = np.where((c >= 0)[:, None], self.escape[k][c], 0)
            k -= 1
        while k >= 0 and len(todo):
            g = grams[todo] & np.uint64((1 << (8 * (k + 1))) - 1)
            at = self.gram[k].find(g)
            hit = at >= 0
            out[todo[hit]] += self.cost[k][at[hit]]
            todo, g = todo[~hit], g[~hit]
            c = self.ctx[k].find(g >> np.uint64(8))
            known = c >= 0
            out[todo[known]] += self.escape[k][c[known]]
            k -= 1
        out[todo] += 8.0  # no order knows the byte: all 256 alike
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text in each class; 0 for empty texts."""
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        out = np.zeros((len(texts), len(self.classes)))
        full = np.flatnonzero(lens)
        if not len(full):
            return out
        gap = b"\0" * self.order
        data = np.frombuffer(gap.join([b"", *(texts[i] for i in full)]), np.uint8)
        grams = _grams(data, self.order)[self.order :]
        costs = self._code(grams, self.order)
        starts = np.concatenate([[0], np.cumsum(lens[full][:-1] + self.order)])
        ends = starts + lens[full]
        edges = np.stack([starts, ends], 1).ravel()
        by_class = np.zeros((costs.shape[1], len(costs) + 1))  # a class a row, so sums run along memory
        by_class[:, :-1] = costs.T
        out[full] = np.add.reduceat(by_class, edges, axis=1)[:, ::2].T
        return out
