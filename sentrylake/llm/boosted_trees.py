"""Histogram gradient-boosted trees for two classes, kept as flat arrays.

Features are cut into at most ``bins`` bins at quantiles of the training rows; each level of a tree sums
gradients per node, feature and bin in one pass and takes the best cut of every node. A tree is a
complete binary tree in arrays (children of i at 2i + 1 and 2i + 2), so that all rows go down all trees
together in as many numpy steps as the trees are deep.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    base: float
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # go right above it; +inf where a node is not split
    value: np.ndarray  # (trees, leaves)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        total = np.full(len(rows), self.base)
        if len(rows) and len(self.feature):
            trees, each = np.arange(len(self.feature)), np.arange(len(rows))[:, None]
            node = np.zeros((len(rows), len(trees)), np.int64)
            for _ in range(int(np.log2(self.value.shape[1]))):
                right = rows[each, self.feature[trees, node]] > self.cut[trees, node]
                node = 2 * node + 1 + right
            total += self.value[trees, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins: midway between neighbouring values near the quantiles."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
    return (values[1:] + values[:-1]) / 2


def fit(
    rows: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64,
    ridge: float = 1.0, least: float = 2.0,
) -> Trees:
    """Trees for labels 0 and 1. Without rows of both classes the score is a constant."""
    n, width = rows.shape
    share = (labels.sum() + 0.5) / (n + 1)
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if n == 0 or labels.min() == labels.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [_edges(rows[:, f], bins) for f in range(width)]
    binned = np.stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    offsets = np.arange(width) * bins
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    total = np.full(n, base)
    for tree in range(trees):
        chance = 1 / (1 + np.exp(-total))
        slope, weight = chance - labels, chance * (1 - chance)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (width * bins) + offsets + binned).ravel()
            shape = (count, width, bins)
            left_s, left_w = (
                np.bincount(cell, np.repeat(x, width), count * width * bins).reshape(shape).cumsum(axis=2)
                for x in (slope, weight)
            )
            all_s, all_w = left_s[:, :, -1:], left_w[:, :, -1:]
            right_s, right_w = all_s - left_s, all_w - left_w
            gain = left_s**2 / (left_w + ridge) + right_s**2 / (right_w + ridge) - all_s**2 / (all_w + ridge)
            gain[(left_w < least) | (right_w < least)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for place in range(count):
                f, b = divmod(int(best[place]), bins)
                if gain[place, f, b] > 1e-6 and b < len(edges[f]):
                    feature[tree, first + place], cut[tree, first + place] = f, edges[f][b]
            node = 2 * node + 1 + (rows[np.arange(n), feature[tree, node]] > cut[tree, node])
        leaf = node - inner
        sums, weights = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, weight, inner + 1)
        value[tree] = -rate * sums / (weights + ridge)
        total += value[tree, leaf]
    return Trees(base, feature, cut, value)
