"""Gradient-boosted regression trees for two classes, on a bounded table of features; small enough to ship to tasks."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of depth 2 or 3 over quantile bins, fitted to the logistic loss."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24) -> None:
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.base = 0.0
        self.forest: list[list[tuple]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        p = min(max(y.mean() if len(y) else 0.0, 1e-4), 1 - 1e-4)
        self.base, self.forest = float(np.log(p / (1 - p))), []
        if not len(y) or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            tree: list[tuple] = []
            self._grow(tree, binned, edges, y - prob, prob * (1 - prob), np.arange(len(y)), self.depth)
            self.forest.append(tree)
            score = score + self._one(tree, x)
        return self

    def _grow(self, tree, b, edges, g, h, idx, depth) -> int:
        at = len(tree)
        gs, hs = g[idx].sum(), h[idx].sum()
        tree.append((-1, 0.0, float(self.rate * gs / (hs + 1.0))))
        if depth == 0 or len(idx) < 20:
            return at
        best = (1e-6, -1, 0)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            cg = np.cumsum(np.bincount(b[idx, f], g[idx], len(e) + 1))[:-1]
            ch = np.cumsum(np.bincount(b[idx, f], h[idx], len(e) + 1))[:-1]
            gain = cg**2 / (ch + 1) + (gs - cg) ** 2 / (hs - ch + 1) - gs**2 / (hs + 1)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), f, i)
        _, f, i = best
        if f < 0:
            return at
        left = b[idx, f] <= i
        if left.all() or not left.any():
            return at
        lo = self._grow(tree, b, edges, g, h, idx[left], depth - 1)
        hi = self._grow(tree, b, edges, g, h, idx[~left], depth - 1)
        tree[at] = (f, float(edges[f][i]), (lo, hi))
        return at

    @staticmethod
    def _one(tree: list[tuple], x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, idx = todo.pop()
            f, v, r = tree[at]
            if f < 0:
                out[idx] = r
                continue
            left = x[idx, f] < v
            todo += [(r[0], idx[left]), (r[1], idx[~left])]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the second class of each row."""
        x = np.asarray(x, float).reshape(-1, np.shape(x)[-1] if np.size(x) else 1)
        score = np.full(len(x), self.base)
        for t in self.forest:
            score += self._one(t, x)
        return 1 / (1 + np.exp(-score))

    def score_one(self, v: tuple[float, ...]) -> float:
        """Probability of the second class of a single row, without arrays."""
        s = self.base
        for t in self.forest:
            at = 0
            while t[at][0] >= 0:
                f, e, (lo, hi) = t[at]
                at = lo if v[f] < e else hi
            s += t[at][2]
        return 1 / (1 + np.exp(-s))
