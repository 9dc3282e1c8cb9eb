"""Histogram gradient-boosted trees in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: feature and threshold of each inner node and value of each leaf, as arrays."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row, all trees at once, a level at a time."""
        trees, inner = self.feature.shape
        if not trees or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node, tree, row = np.zeros((len(x), trees), np.int64), np.arange(trees), np.arange(len(x))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, node - inner].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, smooth: float = 1.0, least: int = 10) -> Trees:
    """Second-order boosting of the logistic loss over quantile histograms.

    Without rows, or with one label only, there are no trees and the score is the smoothed share of label 1.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if len(y) < 2 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    code = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], 1)
    features = x.shape[1]
    flat = code + np.arange(features) * bins
    total, out = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (features * bins) + flat).ravel()
            size = n * features * bins
            g, h, c = (np.bincount(at, np.repeat(v, features), size).reshape(n, features, bins) for v in (grad, hess, np.ones(len(y))))
            gl, hl, cl = (v.cumsum(2) for v in (g, h, c))
            gt, ht, ct = gl[:, :, -1:], hl[:, :, -1:], cl[:, :, -1:]
            gain = gl**2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth) - gt**2 / (ht + smooth)
            gain[(cl < least) | (ct - cl < least)] = -1
            for f, cut in enumerate(cuts):
                gain[:, f, len(cut) :] = -1
            best = gain.reshape(n, -1).argmax(1)
            ok = gain.reshape(n, -1)[np.arange(n), best] > 1e-9
            feature[first : first + n] = np.where(ok, best // bins, 0)
            threshold[first : first + n] = [cuts[b // bins][b % bins] if o else np.inf for b, o in zip(best.tolist(), ok.tolist(), strict=True)]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = rate * np.bincount(node - inner, grad, inner + 1) / (np.bincount(node - inner, hess, inner + 1) + smooth)
        total = total + leaf[node - inner]
        out.append((feature, threshold, leaf))
    return Trees(*(np.stack(v) for v in zip(*out, strict=True)), base)
