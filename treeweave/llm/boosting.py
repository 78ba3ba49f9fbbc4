"""Gradient-boosted trees for yes/no questions, small and in numpy: logistic loss, histograms, trees of fixed depth."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """`cuts` per feature; per tree and inner node a feature and a bin, per leaf a value. All arrays, so a model packs into rows."""

    def __init__(self, cuts: np.ndarray, features: np.ndarray, bins: np.ndarray, leaves: np.ndarray, base: float):
        self.cuts, self.features, self.bins, self.leaves, self.base = cuts, features, bins, leaves, base
        self.depth = int(np.log2(leaves.shape[1])) if leaves.size else 0

    def binned(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(rows.shape, np.uint8)
        for feature, cuts in enumerate(self.cuts):
            out[:, feature] = np.searchsorted(cuts, rows[:, feature], side="left")
        return out

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        binned = self.binned(rows)
        margin = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for features, bins, leaves in zip(self.features, self.bins, self.leaves):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[every, features[node]] > bins[node])
            margin += leaves[node - (len(leaves) - 1)]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    @classmethod
    def fit(
        cls, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2,
        penalty: float = 1.0, least: float = 5.0,
    ) -> BoostedTrees:
        width = rows.shape[1]
        cuts = np.sort(np.quantile(rows, np.linspace(0, 1, BINS + 1)[1:-1], axis=0, method="lower").T, axis=1)
        share = np.clip(np.average(labels, weights=weights), 1e-3, 1 - 1e-3)
        model = cls(cuts, np.zeros((trees, 2 ** depth - 1), np.int64), np.full((trees, 2 ** depth - 1), BINS, np.int64),
                    np.zeros((trees, 2 ** depth)), float(np.log(share / (1 - share))))
        binned = model.binned(rows)
        margin = np.full(len(rows), model.base)
        for tree in range(trees):
            chance = 1 / (1 + np.exp(-margin))
            slope, bend = weights * (labels - chance), weights * chance * (1 - chance)
            node = np.zeros(len(rows), np.int64)
            for level in range(depth):
                first, count = 2 ** level - 1, 2 ** level
                local = node - first
                best_gain = np.full(count, 1e-6)
                for feature in range(width):
                    at = local * BINS + binned[:, feature]
                    g = np.bincount(at, slope, minlength=count * BINS).reshape(count, BINS).cumsum(axis=1)
                    h = np.bincount(at, bend, minlength=count * BINS).reshape(count, BINS).cumsum(axis=1)
                    all_g, all_h = g[:, -1:], h[:, -1:]
                    gain = g * g / (h + penalty) + (all_g - g) ** 2 / (all_h - h + penalty) - all_g ** 2 / (all_h + penalty)
                    gain[(h < least / 4) | (all_h - h < least / 4)] = 0
                    cut = gain.argmax(axis=1)
                    value = gain[np.arange(count), cut]
                    better = value > best_gain
                    best_gain[better] = value[better]
                    model.features[tree, first:first + count][better] = feature
                    model.bins[tree, first:first + count][better] = cut[better]
                node = 2 * node + 1 + (binned[np.arange(len(rows)), model.features[tree, node]] > model.bins[tree, node])
            leaf = node - (2 ** depth - 1)
            g, h = np.bincount(leaf, slope, minlength=2 ** depth), np.bincount(leaf, bend, minlength=2 ** depth)
            model.leaves[tree] = rate * g / (h + penalty)
            margin += model.leaves[tree, leaf]
        return model
