"""A random forest of classification trees over numeric features, in numpy, scored for whole arrays at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees as flat arrays: the feature of each node (-1: leaf), its threshold, its children, its share of label 1."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x) or not self.trees:
            return np.full(len(x), 0.5)
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go_left = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at]
                at = np.where(inner, np.where(go_left, left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


def _best_split(x: np.ndarray, y: np.ndarray, features: np.ndarray) -> tuple[int, float] | None:
    """The cut with the least Gini impurity."""
    best, found = np.inf, None
    n, ones = len(y), y.sum()
    for j in features:
        order = np.argsort(x[:, j], kind="stable")
        v, s = x[order, j], np.cumsum(y[order])
        edges = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(edges):
            continue
        p = s[edges - 1]
        q = ones - p
        impurity = p * (edges - p) / edges + q * (n - edges - q) / (n - edges)
        k = int(np.argmin(impurity))
        if impurity[k] < best - 1e-12:
            best, found = impurity[k], (int(j), float((v[edges[k] - 1] + v[edges[k]]) / 2))
    return found


def train(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, least: int = 2, seed: int = 7) -> Forest:
    """Each tree sees a bootstrap of the rows, each node a random subset of the features."""
    rng = np.random.default_rng(seed)
    if not len(x):
        return Forest([])
    width = max(1, int(np.sqrt(x.shape[1])) + 1)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(x), len(x))
        nodes: list[list] = []

        def grow(rows: np.ndarray, level: int, nodes=nodes) -> int:
            here = len(nodes)
            nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
            if level < depth and len(rows) >= 2 * least and 0 < nodes[here][4] < 1:
                split = _best_split(x[rows], y[rows], rng.choice(x.shape[1], width, replace=False))
                if split:
                    below = x[rows, split[0]] <= split[1]
                    if least <= below.sum() <= len(rows) - least:
                        nodes[here][:2] = split
                        nodes[here][2] = grow(rows[below], level + 1)
                        nodes[here][3] = grow(rows[~below], level + 1)
            return here

        grow(rows, 0)
        out.append(tuple(np.array(c, t) for c, t in zip(zip(*nodes, strict=True), (np.int64, float, np.int64, np.int64, float), strict=True)))
    return Forest(out)
