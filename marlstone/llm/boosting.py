"""Gradient-boosted trees on a small dense matrix, and isotonic calibration; numpy alone."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS, DEPTH, TREES, RATE = 48, 4, 120, 0.1
LEAST_WEIGHT, RIDGE = 2.0, 1.0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Trees:
    """Full binary trees of DEPTH levels: each inner node sends rows above its cut to the right."""

    base: float
    features: np.ndarray  # trees x inner nodes
    cuts: np.ndarray
    leaves: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows of ``x``."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for features, cuts, leaves in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, features[at]] > cuts[at])
            out += leaves[at - len(features)]
        return out


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss over histograms of quantile bins. Deterministic."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    raw, inner = np.full(n, base), 2**DEPTH - 1
    all_features, all_cuts, all_leaves = (np.zeros((TREES, k), t) for k, t in ((inner, np.int64), (inner, float), (inner + 1, float)))
    for t in range(TREES):
        p = sigmoid(raw)
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        all_cuts[t] = np.inf
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            local = at - first
            best, which, where = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, -1)
            for j in range(d):
                k = len(edges[j]) + 1
                if k < 2:
                    continue
                key = local * k + binned[:, j]
                gs = np.bincount(key, g, width * k).reshape(width, k).cumsum(1)
                hs = np.bincount(key, h, width * k).reshape(width, k).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hs < LEAST_WEIGHT) | (ht - hs < LEAST_WEIGHT)] = 0
                cut = gain[:, :-1].argmax(1)
                value = gain[np.arange(width), cut]
                better = value > best
                best, which, where = np.where(better, value, best), np.where(better, j, which), np.where(better, cut, where)
            right = np.zeros(n, bool)
            for node in range(width):
                if where[node] >= 0:
                    all_features[t, first + node], all_cuts[t, first + node] = which[node], edges[which[node]][where[node]]
                    mine = local == node
                    right[mine] = binned[mine, which[node]] > where[node]
            at = 2 * at + 1 + right
        leaf = at - inner
        all_leaves[t] = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        raw += all_leaves[t][leaf]
    return Trees(base, all_features, all_cuts, all_leaves)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the isotonic regression of y on score, one for each pool of neighbours."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # sum of y, number, sum of scores
    for s, v in zip(score[order], y[order], strict=True):
        pools.append([v, 1, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
    p = np.array(pools)
    return p[:, 2] / p[:, 1], p[:, 0] / p[:, 1]
