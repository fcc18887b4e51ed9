"""Gradient-boosted trees for two classes and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of one depth on binned features, fitted to the logistic loss by Newton steps."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(width)]
        codes = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], 1)
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(rate / (1 - rate)))
        self.trees = []
        margin = np.full(n, self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(codes, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += self._leaf(x, tree)
        return self

    def _grow(self, codes: np.ndarray, grad: np.ndarray, hess: np.ndarray):
        node = np.zeros(len(grad), np.int64)
        feature, cut = [], []
        for level in range(self.depth):
            nodes = 1 << level
            best = np.full(nodes, 1e-9)
            at_f, at_c = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
            for f, edges in enumerate(self.edges):
                size = len(edges) + 1
                place = node * size + codes[:, f]
                g = np.bincount(place, grad, nodes * size).reshape(nodes, size).cumsum(1)
                h = np.bincount(place, hess, nodes * size).reshape(nodes, size).cumsum(1)
                if size < 2:
                    continue
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + self.ridge) + (all_g - g) ** 2 / (all_h - h + self.ridge) - all_g**2 / (all_h + self.ridge)
                gain[(h < self.least) | (all_h - h < self.least)] = 0
                k = gain[:, :-1].argmax(1)
                top = gain[np.arange(nodes), k]
                better = top > best
                best[better], at_f[better], at_c[better] = top[better], f, np.asarray(edges)[k[better]]
            feature.append(at_f)
            cut.append(at_c)
            right = np.zeros(len(node), bool)
            for f in np.unique(at_f[np.isfinite(at_c)]):
                own = (at_f[node] == f) & np.isfinite(at_c[node])
                right[own] = codes[own, f] > np.searchsorted(self.edges[f], at_c[node[own]], "left")
            node = node * 2 + right
        g, h = np.bincount(node, grad, 1 << self.depth), np.bincount(node, hess, 1 << self.depth)
        return feature, cut, -self.rate * g / (h + self.ridge)

    def _leaf(self, x: np.ndarray, tree) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for f, c in zip(feature, cut, strict=True):
            node = node * 2 + (x[rows, f[node]] > c[node])
        return value[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += self._leaf(x, tree)
        return out


class Isotonic:
    """The non-decreasing step function nearest to the labels, read between its steps by interpolation."""

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(margin, kind="stable")
        means: list[list[float]] = []  # value, weight, sum of margins
        for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
            means.append([v, 1.0, m])
            while len(means) > 1 and means[-2][0] >= means[-1][0]:
                value, weight, total = means.pop()
                last = means[-1]
                last[0] = (last[0] * last[1] + value * weight) / (last[1] + weight)
                last[1] += weight
                last[2] += total
        self.x = np.array([total / weight for _, weight, total in means])
        self.y = np.array([value for value, _, _ in means])
        return self

    def score(self, margin: np.ndarray) -> np.ndarray:
        """Calibrated scores from 0 to 1; a thousandth comes from the margin, so that its order isn't lost on flat steps."""
        return 0.999 * np.interp(margin, self.x, self.y) + 0.001 / (1 + np.exp(-margin))
