"""Histogram gradient-boosted trees for the logistic loss, and isotonic calibration, on bounded numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Boosted:
    """Complete binary trees of one depth: node k has children 2k+1 and 2k+2; a row goes right if its value exceeds the cut."""

    base: float
    depth: int
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 1.0, l2: float = 1.0) -> Boosted:
    """Newton boosting on quantile bins; ``least`` is the smallest sum of second derivatives of a child."""
    mean = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(mean / (1 - mean))), depth)
    if not len(y) or y.min() == y.max():
        return model
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin = np.full(n, model.base)
    inner, size = 2**depth - 1, max(len(e) for e in edges) + 1
    for _ in range(trees):
        p = sigmoid(margin)
        g, h = y - p, p * (1 - p)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            best = np.full(many, 1e-6)
            for j in range(width):
                if not len(edges[j]):
                    continue
                at = (node - first) * size + binned[:, j]
                gs = np.bincount(at, g, many * size).reshape(many, size).cumsum(axis=1)
                hs = np.bincount(at, h, many * size).reshape(many, size).cumsum(axis=1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least) | (ht - hl < least)] = 0
                gain = gain[:, : len(edges[j])]
                top = gain.argmax(axis=1)
                better = gain[np.arange(many), top] > best
                best[better] = gain[np.arange(many), top][better]
                feature[first : first + many][better] = j
                cut[first : first + many][better] = edges[j][top][better]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        values = rate * gs / (hs + l2)
        margin += values[leaf]
        model.features.append(feature)
        model.cuts.append(cut)
        model.leaves.append(values)
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nondecreasing least-squares fit by pooling adjacent violators: knots ``(score, value)`` for linear interpolation."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first score, last score
    for s, v in zip(score[order], y[order]):
        blocks.append([float(v), 1.0, float(s), float(s)])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    xs, ys = [], []
    for total, weight, lo, hi in blocks:
        for s in (lo,) if lo == hi else (lo, hi):
            xs.append(s)
            ys.append(total / weight)
    return np.array(xs), np.array(ys)
