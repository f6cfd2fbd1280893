"""Small gradient-boosted trees for binary labels, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Logistic boosting of depth-limited trees over quantile bins. Deterministic."""

    trees: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 64
    least: float = 5.0
    ridge: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    nodes: list[list[tuple]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        p = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-f))
            tree: list[tuple] = []
            self._grow(b, y - q, np.maximum(q * (1 - q), 1e-6), np.arange(len(y)), 0, tree, f)
            self.nodes.append(tree)
        return self

    def _grow(self, b, g, h, rows, level, tree, f) -> int:
        """Adds a node (feature, bin, left, right, value) for rows and returns its number; leaves move f."""
        me, total_g, total_h = len(tree), g[rows].sum(), h[rows].sum()
        value = self.rate * total_g / (total_h + self.ridge)
        tree.append((-1, 0, 0, 0, value))
        best = (1e-6, -1, 0)
        if level < self.depth and total_h > 2 * self.least * 0.05 and len(rows) >= 2 * self.least:
            for j in range(b.shape[1]):
                k = len(self.edges[j]) + 1
                c = np.bincount(b[rows, j], minlength=k).cumsum()[:-1]
                sg = np.bincount(b[rows, j], g[rows], k).cumsum()[:-1]
                sh = np.bincount(b[rows, j], h[rows], k).cumsum()[:-1]
                gain = sg**2 / (sh + self.ridge) + (total_g - sg) ** 2 / (total_h - sh + self.ridge) - total_g**2 / (total_h + self.ridge)
                gain[(c < self.least) | (len(rows) - c < self.least)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), j, int(gain.argmax()))
        if best[1] < 0:
            f[rows] += value
            return me
        left = b[rows, best[1]] <= best[2]
        a = self._grow(b, g, h, rows[left], level + 1, tree, f)
        z = self._grow(b, g, h, rows[~left], level + 1, tree, f)
        tree[me] = (best[1], best[2], a, z, value)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Uncalibrated probabilities."""
        b, f = self._binned(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for tree in self.nodes:
            j, cut, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                inner = j[at] >= 0
                at = np.where(inner, np.where(b[rows, j[at]] <= cut[at], left[at], right[at]), at)
            f += value[at]
        return 1 / (1 + np.exp(-f))


@dataclass
class Isotonic:
    """Pool-adjacent-violators fit, interpolated between the pooled blocks."""

    x: np.ndarray | None = None
    y: np.ndarray | None = None

    def fit(self, score: np.ndarray, label: np.ndarray) -> Isotonic:
        o = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, rows, sum of scores
        for s, v in zip(score[o], label[o], strict=True):
            blocks.append([float(v), 1.0, float(s)])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + z for a, z in zip(blocks[-1], last, strict=True)]
        self.x = np.array([b[2] / b[1] for b in blocks])
        self.y = np.array([b[0] / b[1] for b in blocks])
        return self

    def predict(self, score: np.ndarray) -> np.ndarray:
        """Calibrated probability; a thousandth of the score keeps the order within a block."""
        return np.clip(0.999 * np.interp(score, self.x, self.y) + 0.001 * score, 0.0, 1.0)
