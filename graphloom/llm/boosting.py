"""Gradient-boosted regression trees for a 0/1 label, fitted on a bounded sample on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Tree:
    """Node k tests feature[k] <= cut[k] and goes on to 2k + 1, else to 2k + 2; leaves hold values."""

    depth: int
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray


@dataclass
class BoostedTrees:
    """Logistic boosting by Newton steps on histograms of quantile bins."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 64
    ridge: float = 1.0
    least: int = 5
    start: float = 0.0
    fitted: list[Tree] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """x: rows of features without nulls; y: 0 or 1. Without rows every score is even odds."""
        self.fitted = []
        if not len(y):
            return self
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.start = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(column, np.arange(1, self.bins) / self.bins)) for column in x.T]
        binned = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)], 1)
        margin = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            tree, leaf = self._grow(binned, cuts, p - y, p * (1 - p))
            self.fitted.append(tree)
            margin += tree.value[leaf]
        return self

    def _grow(self, binned, cuts, gradient, curvature) -> tuple[Tree, np.ndarray]:
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
        at = np.zeros(len(gradient), int)  # position in the current level
        for level in range(self.depth):
            nodes = 2**level
            best = np.full(nodes, 1e-6)
            chosen = [(0, None)] * nodes
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                width = len(c) + 1
                cell = at * width + binned[:, f]
                g, h, n = (np.bincount(cell, w, nodes * width).reshape(nodes, width).cumsum(1) for w in (gradient, curvature, None))
                left = g[:, :-1] ** 2 / (h[:, :-1] + self.ridge)
                right = (g[:, -1:] - g[:, :-1]) ** 2 / (h[:, -1:] - h[:, :-1] + self.ridge)
                gain = left + right - g[:, -1:] ** 2 / (h[:, -1:] + self.ridge)
                gain[(n[:, :-1] < self.least) | (n[:, -1:] - n[:, :-1] < self.least)] = 0
                top = gain.argmax(1)
                for node in np.flatnonzero(gain[np.arange(nodes), top] > best):
                    best[node], chosen[node] = gain[node, top[node]], (f, int(top[node]))
            goes = np.zeros(len(at), bool)
            for node, (f, k) in enumerate(chosen):
                place = nodes - 1 + node
                if k is not None:
                    feature[place], cut[place] = f, cuts[f][k]
                    goes |= (at == node) & (binned[:, f] > k)
            at = 2 * at + goes
        leaves = 2**self.depth
        g, h = np.bincount(at, gradient, leaves), np.bincount(at, curvature, leaves)
        return Tree(self.depth, feature, cut, -self.rate * g / (h + self.ridge)), at

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1."""
        return self.margins(x)[-1]

    def margins(self, x: np.ndarray) -> list[np.ndarray]:
        """Log-odds of label 1 before the first tree and after each."""
        out, rows = [np.full(len(x), self.start)], np.arange(len(x))
        for tree in self.fitted:
            at = np.zeros(len(x), int)
            for _ in range(tree.depth):
                at = 2 * at + 1 + (x[rows, tree.feature[at]] > tree.cut[at])
            out.append(out[-1] + tree.value[at - (2**tree.depth - 1)])
        return out

    def margin_column(self, features: list[Column]) -> Column:
        """The same as one expression of built-in functions."""

        def node(tree: Tree, k: int) -> Column:
            if k >= len(tree.feature):
                return F.lit(float(tree.value[k - len(tree.feature)]))
            if np.isinf(tree.cut[k]):
                return node(tree, 2 * k + 1)
            low = features[int(tree.feature[k])] <= float(tree.cut[k])
            return F.when(low, node(tree, 2 * k + 1)).otherwise(node(tree, 2 * k + 2))

        steps = F.array(F.lit(float(self.start)), *[node(tree, 0) for tree in self.fitted])
        return F.aggregate(steps, F.lit(0.0), lambda a, b: a + b)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function of score nearest to y, by pooling adjacent violators.

    Returns scores and their probabilities; between them the function is interpolated. Each
    pooled block counts half a positive and half a negative more, so no block is certain.
    """
    levels, at = np.unique(score, return_inverse=True)  # equal scores are one value from the start
    sums, rows = np.bincount(at, y, len(levels)), np.bincount(at, minlength=len(levels))
    blocks: list[list[float]] = []  # sum of y, rows, first score, last score
    for v, n, s in zip(sums.tolist(), rows.tolist(), levels.tolist(), strict=True):
        blocks.append([v, n, s, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            total, many, _, end = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += many
            blocks[-1][3] = end
    at, probability = [], []
    for total, rows, first, end in blocks:
        p = (total + 0.5) / (rows + 1)
        at += [first] if first == end else [first, end]
        probability += [p] if first == end else [p, p]
    if not at:
        return np.array([0.0]), np.array([0.5])
    return np.array(at), np.maximum.accumulate(np.array(probability))
