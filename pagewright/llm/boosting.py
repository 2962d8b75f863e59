"""A small gradient-boosted tree model (logistic loss, histogram splits) for bounded samples; it is trained on the driver and shipped with a function."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees are flat arrays: feature, threshold, and leaf values of a complete binary tree of `depth`."""

    def __init__(self, n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.ridge = n_trees, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        codes = np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], 1)
        score = np.full(len(y), self.base)
        inner = (1 << self.depth) - 1
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                for k in range((1 << level) - 1, (1 << (level + 1)) - 1):
                    own = node == k
                    if own.sum() < 8:
                        continue
                    best = 1e-9
                    total_g, total_h = g[own].sum(), h[own].sum()
                    for f, e in enumerate(edges):
                        if not len(e):
                            continue
                        gs = np.cumsum(np.bincount(codes[own, f], g[own], len(e) + 1))[:-1]
                        hs = np.cumsum(np.bincount(codes[own, f], h[own], len(e) + 1))[:-1]
                        gain = gs**2 / (hs + self.ridge) + (total_g - gs) ** 2 / (total_h - hs + self.ridge) - total_g**2 / (total_h + self.ridge)
                        at = int(np.argmax(gain))
                        if gain[at] > best:
                            best, feature[k], threshold[k] = gain[at], f, e[at]
                split = threshold[node] < np.inf
                right = x[np.arange(len(y)), feature[node]] >= threshold[node]
                node = 2 * node + 1 + (right & split)
            leaf = node - inner
            gs, hs = np.bincount(leaf, g, 1 << self.depth), np.bincount(leaf, h, 1 << self.depth)
            value = self.rate * gs / (hs + self.ridge)
            self.trees.append((feature, threshold, value))
            score += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities."""
        x = np.asarray(x, np.float64).reshape(-1, np.shape(x)[-1] if np.ndim(x) > 1 else len(x))
        score = np.full(len(x), self.base)
        inner, rows = (1 << self.depth) - 1, np.arange(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] >= threshold[node])
            score += value[node - inner]
        return 1 / (1 + np.exp(-score))
