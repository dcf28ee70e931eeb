"""Gradient boosted trees for small feature tables, and probability calibration."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting of regression trees of a fixed depth over binned features."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 24, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        """x: rows by features; y: 0 or 1. A label that never varies gives a constant score."""
        x = np.asarray(x, dtype=np.float64)
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], axis=1)
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._tree(codes, y - p, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            score += self._apply(codes, tree)
        return self

    def _tree(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = 2**self.depth - 1
        feature, cut, value = np.zeros(inner, dtype=np.int64), np.full(inner, 1 << 20), np.zeros(inner + 2**self.depth)
        node = np.zeros(len(g), dtype=np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            if len(rows) >= 8:
                gs, hs = g[rows], h[rows]
                whole = gs.sum() ** 2 / (hs.sum() + self.l2)
                best = 1e-4
                for f in range(codes.shape[1]):
                    c = codes[rows, f]
                    n = int(c.max()) + 1
                    if n == 1:
                        continue
                    gl = np.cumsum(np.bincount(c, gs, n))[:-1]
                    hl = np.cumsum(np.bincount(c, hs, n))[:-1]
                    gain = gl**2 / (hl + self.l2) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + self.l2) - whole
                    at = int(np.argmax(gain))
                    if gain[at] > best:
                        best, feature[k], cut[k] = gain[at], f, at
            right = codes[rows, feature[k]] > cut[k]
            node[rows] = 2 * k + 1 + right
        for k in range(inner, len(value)):
            rows = node == k
            value[k] = self.rate * g[rows].sum() / (h[rows].sum() + self.l2)
        return feature, cut, value

    def _apply(self, codes: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(codes), dtype=np.int64)
        rows = np.arange(len(codes))
        for _ in range(self.depth):
            node = 2 * node + 1 + (codes[rows, feature[node]] > cut[node])
        return value[node]

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=np.float64)
        if not len(x):
            return np.zeros(0)
        codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], axis=1)
        return self.base + sum(self._apply(codes, t) for t in self.trees)


class Calibration:
    """Platt scaling of scores to probabilities by Newton steps on held-out rows."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> "Calibration":
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-(a * score + b)))
            w = np.maximum(p * (1 - p), 1e-6)
            grad = np.array([((y - p) * score).sum() - 1e-2 * (a - 1), (y - p).sum()])
            hess = np.array([[(w * score * score).sum() + 1e-2, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-2]])
            step = np.linalg.solve(hess, grad)
            a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -2, 2))
        self.a, self.b = max(a, 0.05), b
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * score + self.b, -40, 40)))


def best_threshold(p: np.ndarray, y: np.ndarray, least: float = 0.4, most: float = 0.8) -> float:
    """The threshold within bounds with the best F1 on held-out rows; the middle of a plateau."""
    grid = np.linspace(least, most, 25)
    f1 = np.array([2 * (y * (p >= t)).sum() / max(1.0, y.sum() + (p >= t).sum()) for t in grid])
    top = grid[f1 >= f1.max() - 1e-9]
    return float(top[len(top) // 2])
