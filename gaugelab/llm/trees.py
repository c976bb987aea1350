"""Gradient-boosted trees for small labelled samples: histogram splits, logistic loss, numpy alone.

A model is plain lists, so that it can be sent to executors, applied to arrays, or written out as a DataFrame expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Trees:
    """``trees``: for each, nodes (feature, threshold, left, right, value); feature -1 marks a leaf; values up to the threshold go left."""

    start: float
    trees: list[list[tuple[int, float, int, int, float]]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of ``x``."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for nodes in self.trees:
            f, t, lo, hi, v = (np.array(c) for c in zip(*nodes))
            at = np.zeros(len(x), int)
            while (open_ := f[at] >= 0).any():
                left = x[rows, np.maximum(f[at], 0)] <= t[at]
                at = np.where(open_, np.where(left, lo[at], hi[at]), at)
            out += v[at]
        return out

    def column(self, features: list[Column]) -> Column:
        """The same as an expression; ``features`` should be bound (columns or lambda variables), as each is read often."""

        def of(nodes, k):
            f, t, lo, hi, v = nodes[k]
            return F.lit(float(v)) if f < 0 else F.when(features[f] <= F.lit(float(t)), of(nodes, lo)).otherwise(of(nodes, hi))

        out = F.lit(self.start)
        for nodes in self.trees:
            out = out + of(nodes, 0)
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0, smooth: float = 1.0) -> Trees:
    """Newton boosting: each tree fits gradients by the best of ``bins`` quantile cuts of each feature, level by level."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    coded = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    raw, trees = np.full(len(y), start), []
    width = max((len(c) for c in cuts), default=0) + 1
    cells = (coded + width * np.arange(x.shape[1])).astype(np.int32)  # one histogram holds all features
    none = np.arange(width)[None, :-1] >= np.array([len(c) for c in cuts])[:, None]  # places that are no cut of their feature

    def sums(rows: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Of ``v`` over the rows up to each cut of each feature."""
        found = np.bincount(cells[rows].ravel(), np.repeat(v[rows], x.shape[1]), width * x.shape[1])
        return np.cumsum(found.reshape(x.shape[1], width), 1)[:, :-1]

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-raw))
        g, h = y - q, np.maximum(q * (1 - q), 1e-9)
        nodes: list[tuple] = []

        def grow(rows: np.ndarray, left: int) -> int:
            at = len(nodes)
            value = rate * g[rows].sum() / (h[rows].sum() + smooth)
            nodes.append((-1, 0.0, 0, 0, float(value)))
            j = -1
            if left and len(rows) > 1 and width > 1:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                lg, lh = sums(rows, g), sums(rows, h)
                rg, rh = total_g - lg, total_h - lh
                gain = lg**2 / (lh + smooth) + rg**2 / (rh + smooth) - total_g**2 / (total_h + smooth)
                gain[(lh < least) | (rh < least) | none] = 0
                best = int(gain.argmax())
                if gain.flat[best] > 1e-6:
                    j, k = divmod(best, width - 1)
            if j >= 0:
                to_left = coded[rows, j] <= k
                lo = grow(rows[to_left], left - 1)
                hi = grow(rows[~to_left], left - 1)
                nodes[at] = (j, float(cuts[j][k]), lo, hi, 0.0)
            else:
                raw[rows] += value
            return at

        grow(np.arange(len(y)), depth)
        trees.append(nodes)
    return Trees(start, trees)
