"""Gradient-boosted regression trees for a yes-or-no outcome, in plain numpy, and Platt's calibration of their scores."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class BoostedTrees:
    """Trees of depth 2 on the logistic loss with Newton leaves. The same rows give the same trees."""

    def __init__(self, trees: int = 40, rate: float = 0.3, least_leaf: float = 1.0, cuts: int = 32):
        self.n, self.rate, self.ridge, self.cuts = trees, rate, least_leaf, cuts
        self.trees: list[tuple] = []
        self.scale, self.shift = 1.0, 0.0

    def _split(self, x: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, float]:
        best, at = -1.0, (0, np.inf)
        total_g, total_h = grad.sum(), hess.sum()
        for f in range(x.shape[1]):
            for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.cuts + 2)[1:-1])) if len(x) else ():
                left = x[:, f] <= c
                g, h = grad[left].sum(), hess[left].sum()
                gain = g * g / (h + self.ridge) + (total_g - g) ** 2 / (total_h - h + self.ridge)
                if gain > best + 1e-12:
                    best, at = gain, (f, float(c))
        return at

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        raw = np.zeros(len(y))
        for _ in range(self.n):
            p = sigmoid(raw)
            grad, hess = y - p, p * (1 - p)
            f, c = self._split(x, grad, hess)
            sides = []
            for side in (x[:, f] <= c, x[:, f] > c):
                g, d = self._split(x[side], grad[side], hess[side])
                leaves = [float(grad[s].sum() / (hess[s].sum() + self.ridge)) for s in (side & (x[:, g] <= d), side & (x[:, g] > d))]
                sides.append((g, d, *leaves))
            self.trees.append((f, c, *sides))
            raw += self.rate * self._one(self.trees[-1], x)
        return self

    @staticmethod
    def _one(tree: tuple, x: np.ndarray) -> np.ndarray:
        f, c, low, high = tree
        value = lambda side: np.where(x[:, side[0]] <= side[1], side[2], side[3])
        return np.where(x[:, f] <= c, value(low), value(high))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.rate * sum((self._one(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Platt's scaling on rows that were not fitted."""
        raw = self.raw(x)
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = sigmoid(a * raw + b)
            w = p * (1 - p) + 1e-9
            g = np.array([((target - p) * raw).sum(), (target - p).sum()])
            h = np.array([[(w * raw * raw).sum() + 1e-6, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            a, b = a + step[0], b + step[1]
        self.scale, self.shift = float(a), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.raw(x) + self.shift)
