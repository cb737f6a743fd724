"""Gradient-boosted trees for a few classes, in NumPy: small enough to be fitted on the driver and broadcast."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Softmax boosting of depth-limited trees over quantile bins, with a temperature for its probabilities."""

    def __init__(self, classes: int, rounds: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 32, ridge: float = 1.0):
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.ridge = classes, rounds, depth, rate, bins, ridge
        self.temperature = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """``y``: class numbers. Classes are weighted to count alike."""
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], q)) for f in range(x.shape[1])]
        b = self._binned(x)
        n, k = len(x), self.classes
        share = np.bincount(y, minlength=k)
        weight = (n / (np.count_nonzero(share) * np.maximum(share, 1)))[y]
        target = np.eye(k)[y]
        raw = np.zeros((n, k))
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        for _ in range(self.rounds):
            p = self._softmax(raw)
            level = []
            for c in range(k):
                g, h = weight * (p[:, c] - target[:, c]), weight * np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
                tree = self._tree(b, g, h)
                level.append(tree)
                raw[:, c] += self._leaf(tree, b)
            self.trees.append(level)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], 1).astype(np.int32)

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A complete binary tree: feature and bin per inner node, value per leaf."""
        inner = 2**self.depth - 1
        feature, cut, node = np.zeros(inner, np.int32), np.full(inner, self.bins, np.int32), np.zeros(len(b), np.int32)
        wide = np.arange(b.shape[1], dtype=np.int32) * self.bins
        for i in range(inner):
            rows = np.flatnonzero(node == i)
            if len(rows) > 1:
                flat = (b[rows] + wide).ravel()
                size = b.shape[1] * self.bins
                gs = np.bincount(flat, np.repeat(g[rows], b.shape[1]), size).reshape(-1, self.bins).cumsum(1)
                hs = np.bincount(flat, np.repeat(h[rows], b.shape[1]), size).reshape(-1, self.bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                best = int(gain[:, :-1].argmax())
                f, c = divmod(best, self.bins - 1)
                if gain[f, c] > 1e-6:
                    feature[i], cut[i] = f, c
            node[rows] = 2 * i + 1 + (b[rows, feature[i]] > cut[i])
        leaf = node - inner
        size = 2**self.depth
        value = -np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + self.ridge) * self.rate
        return feature, cut, value

    def _leaf(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), np.int32)
        for _ in range(self.depth):
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        return value[node - (2**self.depth - 1)]

    @staticmethod
    def _softmax(raw: np.ndarray) -> np.ndarray:
        e = np.exp(raw - raw.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Scores before the softmax."""
        b, out = self._binned(x), np.zeros((len(x), self.classes))
        for level in self.trees:
            for c, tree in enumerate(level):
                out[:, c] += self._leaf(tree, b)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, one row per row of ``x``."""
        return self._softmax(self.raw(x) / self.temperature) if len(x) else np.zeros((0, self.classes))

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        """Mean log loss of the probabilities."""
        return float(-np.log(np.maximum(self.predict(x)[np.arange(len(y)), y], 1e-12)).mean())

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Choose the temperature of least log loss on a holdout; it can sharpen or soften."""
        raw = self.raw(x)
        loss = lambda t: -np.log(np.maximum(self._softmax(raw / t)[np.arange(len(y)), y], 1e-12)).mean()
        self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
        return self
