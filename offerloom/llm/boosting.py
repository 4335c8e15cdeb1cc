"""Gradient-boosted trees for yes or no, small enough for a driver, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees of equal depth: a node's feature and cut, and the leaves' values."""

    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 24, ridge: float = 2.0) -> Boosted:
    """Newton boosting of the logistic loss over binned features."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(start=float(np.log(share / (1 - share))))
    raw, inner = np.full(len(y), model.start), 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best = 1e-6
            below = np.zeros(len(rows), bool)
            if len(rows) >= 8:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, f]
                    left_g = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                    gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
                    if gain.max() > best:
                        best, feature[at], cut[at] = gain.max(), f, e[gain.argmax()]
                        below = b > gain.argmax()
            node[rows] = 2 * at + 1 + below
        leaf = np.array([rate * g[m].sum() / (h[m].sum() + ridge) if (m := node == inner + j).any() else 0.0 for j in range(inner + 1)])
        raw += leaf[node - inner]
        model.features.append(feature)
        model.cuts.append(cut)
        model.leaves.append(leaf)
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray) -> None:
    """Platt's scaling on rows that the trees have not seen."""
    raw = model.raw(x)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((target - p) * raw).sum(), (target - p).sum()])
        h = np.array([[(w * raw * raw).sum(), (w * raw).sum()], [(w * raw).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.shift = float(max(a, 1e-3)), float(b)


def lower_bound(good: int, n: int, error: float) -> float:
    """Exact (Clopper-Pearson) lower bound of a share of ``good`` in ``n``."""
    from math import exp, lgamma, log

    if not good:
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(40):
        p = (lo + hi) / 2
        terms = [lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(p) + (n - j) * log(max(1 - p, 1e-300)) for j in range(good, n + 1)]
        lo, hi = (p, hi) if sum(map(exp, terms)) < error else (lo, p)
    return lo


def threshold(p: np.ndarray, y: np.ndarray, precision: float, error: float) -> float:
    """The lowest probability above which so many of held-out rows are right, by
    an exact bound; over 1 if none is.

    Cuts are tested from high to low and the first failure ends it, which needs
    no correction along the sequence. A cut that too few rows pass for any bound
    to reach ``precision`` is no test.
    """
    least, best = int(np.ceil(np.log(error) / np.log(precision))), 2.0
    for cut in np.linspace(0.99, 0.5, 50):
        told = p >= cut
        if told.sum() < least:
            continue
        if lower_bound(int(y[told].sum()), int(told.sum()), error) < precision:
            break
        best = float(cut)
    return best
