"""Gradient-boosted trees for two classes, and isotonic calibration, in numpy.

Trained on the driver from a bounded sample; small enough to be sent to every task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """A complete binary tree of fixed depth: node k has children 2k+1 and 2k+2; rows go right where feature > cut."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while node.size and node[0] < len(self.feature):  # all rows are at the same depth
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.cut[node])
        return self.value[node - len(self.feature)]


@dataclass
class Boosted:
    """Logistic loss, second-order leaves, cuts at quantiles."""

    depth: int = 3
    rounds: int = 80
    rate: float = 0.15
    bins: int = 32
    penalty: float = 1.0
    least: float = 3.0
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start, self.trees = float(np.log(share / (1 - share))), []
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)  # bin b: x <= cuts[b]
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            self.trees.append(self._grow(x, binned, cuts, p - y, np.maximum(p * (1 - p), 1e-6)))
            margin += self.trees[-1].predict(x)
        return self

    def _grow(self, x: np.ndarray, binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> Tree:
        inner = 2**self.depth - 1
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(g), np.int64)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            best = (1e-9, 0, np.inf)
            if len(own):
                total_g, total_h = g[own].sum(), h[own].sum()
                base = total_g**2 / (total_h + self.penalty)
                for f, c in enumerate(cuts):
                    gl = np.cumsum(np.bincount(binned[own, f], g[own], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[own, f], h[own], len(c) + 1))[:-1]
                    nl = np.cumsum(np.bincount(binned[own, f], minlength=len(c) + 1))[:-1]
                    gain = gl**2 / (hl + self.penalty) + (total_g - gl) ** 2 / (total_h - hl + self.penalty) - base
                    gain[(nl < self.least) | (len(own) - nl < self.least)] = -1
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), f, c[int(gain.argmax())])
            feature[k], cut[k] = best[1:]
            node[own] = 2 * k + 1 + (x[own, feature[k]] > cut[k])
        leaf = node - inner
        value = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.penalty) * self.rate
        return Tree(feature, cut, value)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


@dataclass
class Isotonic:
    """A rising step function by pooling adjacent violators, interpolated between block centres."""

    at: np.ndarray = field(default_factory=lambda: np.zeros(1))
    value: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        blocks: list[list[float]] = []
        for v, t in zip(x[order], y[order], strict=True):
            blocks.append([v, t, 1.0])
            while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
                (v1, t1, n1), (v2, t2, n2) = blocks[-2:]
                blocks[-2:] = [[(v1 * n1 + v2 * n2) / (n1 + n2), (t1 * n1 + t2 * n2) / (n1 + n2), n1 + n2]]
        self.at, self.value = np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.at, self.value)
