"""Histogram gradient-boosted trees in numpy, flattened into node arrays for vectorised scoring.

Features are cut into at most 64 bins at quantiles of the training sample. Trees grow level by level on
gradient and hessian histograms of the logistic loss. A monotonic feature (+1 or -1) may only be split so that
the two children's values keep its direction, and both children are held to the midpoint between them, so
the whole model is monotonic in it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees' nodes in common arrays; a leaf points to itself. Node 0 of each tree is at ``roots``."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, from 0 to 1."""
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))
        return values
    return (values[:-1] + values[1:]) / 2


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Forest:
    """Fit on rows ``x`` and labels ``y`` in {0, 1}. No rows, or one class only: the constant smoothed share."""
    n = len(y)
    share = (float(np.sum(y)) + 1.0) / (n + 2.0)
    base = float(np.log(share / (1 - share)))
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if n and 0 < np.sum(y) < n:
        sign = np.zeros(x.shape[1], dtype=int)
        for f, s in (monotone or {}).items():
            sign[f] = s
        edges = [_edges(x[:, f], bins) for f in range(x.shape[1])]
        coded = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        usable = np.zeros((x.shape[1], bins + 1), dtype=bool)
        for f, e in enumerate(edges):
            usable[f, : len(e)] = True
        flat = coded + np.arange(x.shape[1]) * (bins + 1)
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
            queue = [(roots[-1], np.arange(n), -np.inf, np.inf, 0)]
            while queue:
                k, rows, low, high, level = queue.pop()
                g, h = grad[rows].sum(), hess[rows].sum()
                nodes[k][4] = float(np.clip(-g / (h + ridge), low, high)) * rate
                if level < depth and len(rows) >= 2 * least:
                    width = flat.shape[1]
                    gs, hs, cs = (np.bincount(flat[rows].ravel(), np.repeat(w, width), width * (bins + 1)).reshape(width, -1).cumsum(axis=1) for w in (grad[rows], hess[rows], np.ones(len(rows))))
                    lv, rv = (np.clip(-a / (b + ridge), low, high) for a, b in ((gs, hs), (g - gs, h - hs)))
                    gain = -(gs * lv + 0.5 * (hs + ridge) * lv**2) - ((g - gs) * rv + 0.5 * (h - hs + ridge) * rv**2)
                    own = float(np.clip(-g / (h + ridge), low, high))
                    gain -= -(g * own + 0.5 * (h + ridge) * own**2)
                    ok = usable & (cs >= least) & (len(rows) - cs >= least) & (sign[:, None] * (rv - lv) >= 0)
                    gain = np.where(ok, gain, -np.inf)
                    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[f, b] > 1e-6:
                        goes = coded[rows, f] <= b
                        nodes[k][:4] = [int(f), float(edges[f][b]), len(nodes), len(nodes) + 1]
                        middle = (lv[f, b] + rv[f, b]) / 2
                        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(sign[f])]
                        for side, (lo, hi) in zip((goes, ~goes), bounds):
                            queue.append((len(nodes), rows[side], lo, hi, level + 1))
                            nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
                        continue
                margin[rows] += nodes[k][4]
    columns = list(zip(*nodes)) if nodes else [[], [], [], [], []]
    kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
    feature, threshold, left, right, value = (np.array(c, dtype=t) for c, t in zip(columns, kinds))
    return Forest(base, np.array(roots, dtype=np.int64), feature, threshold, left, right, value, depth)
