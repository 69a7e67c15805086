"""Gradient-boosted trees over a few numeric features, for samples that fit one task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH, ROUNDS, RATE, BINS = 3, 40, 0.2, 32


@dataclass
class Trees:
    """Full binary trees: at node i of a tree, go to 2i+1 where the feature is at most the cut,
    else to 2i+2; the last level holds the values. Slope and shift calibrate the sum."""

    features: np.ndarray
    cuts: np.ndarray
    values: np.ndarray
    base: float
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.features, self.cuts, self.values, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2 ** DEPTH - 1)]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * self.scores(x) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for the log-odds of ``y``, by Newton steps on binned features; ties between cuts go
    to the first feature and the lowest cut."""
    y = y.astype(np.float64)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
            for c in x.T]
    binned = np.stack([np.searchsorted(k, c) for k, c in zip(cuts, x.T, strict=True)], 1)
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    features = np.zeros((ROUNDS, inner), np.int64)
    limits = np.full((ROUNDS, inner), np.inf)
    values = np.zeros((ROUNDS, leaves))
    total = np.full(len(y), base)
    for number in range(ROUNDS):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for at in range(inner):
            own = node == at
            cut = _best_cut(binned[own], g[own], h[own], cuts)
            right = np.zeros(len(y), bool)
            if cut:
                features[number, at], limits[number, at] = cut
                right = own & (x[:, cut[0]] > cut[1])
            node = np.where(right, 2 * at + 2, np.where(own, 2 * at + 1, node))
        leaf = node - inner
        step = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1.0)
        values[number] = step
        total += step[leaf]
    return Trees(features, limits, values, base)


def _best_cut(binned, g, h, cuts) -> tuple[int, float] | None:
    best, found = 1e-6, None
    if not len(g):
        return None
    g_all, h_all = g.sum(), h.sum()
    for feature, of in enumerate(cuts):
        if not len(of):
            continue
        gl = np.cumsum(np.bincount(binned[:, feature], g, len(of) + 1))[:-1]
        hl = np.cumsum(np.bincount(binned[:, feature], h, len(of) + 1))[:-1]
        gain = gl ** 2 / (hl + 1) + (g_all - gl) ** 2 / (h_all - hl + 1) \
            - g_all ** 2 / (h_all + 1)
        at = int(gain.argmax())
        if gain[at] > best:
            best, found = float(gain[at]), (feature, float(of[at]))
    return found
