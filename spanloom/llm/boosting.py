"""Gradient-boosted trees for a binary label, and isotonic calibration; trained on the driver over a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


@dataclass
class Tree:
    """A complete tree: feature and threshold of each inner node, value of each leaf; x > threshold goes right."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(int(np.log2(len(self.value)))):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.threshold[node])
        return self.value[node - len(self.feature)]


@dataclass
class Boosted:
    """Log-odds of the label: a prior and shrunk trees."""

    prior: float
    trees: list[Tree] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.prior + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


def _grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, shrink: float, l2: float, least: int) -> Tree:
    inner = 2**depth - 1
    feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
    at = np.zeros(len(g), dtype=np.int64)
    for node in range(inner):
        rows = np.flatnonzero(at == node)
        best = (1e-9, 0, np.inf, None)
        for f, cuts in enumerate(edges if len(rows) >= 2 * least else []):
            if not len(cuts):
                continue
            size = len(cuts) + 1
            gs, hs, n = (np.cumsum(np.bincount(binned[rows, f], w, size))[:-1] for w in (g[rows], h[rows], None))
            right_g, right_h = g[rows].sum() - gs, h[rows].sum() - hs
            gain = gs**2 / (hs + l2) + right_g**2 / (right_h + l2) - (gs + right_g) ** 2 / (hs + right_h + l2)
            gain[(n < least) | (len(rows) - n < least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float(cuts[k]), k)
        _, feature[node], threshold[node], k = best
        at[rows] = 2 * node + 1 + (binned[rows, feature[node]] > (BINS if k is None else k))
    leaf = at - inner
    sums = [np.bincount(leaf, w, inner + 1) for w in (g, h)]
    return Tree(feature, threshold, -shrink * sums[0] / (sums[1] + l2))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, shrink: float = 0.15, l2: float = 1.0, least: int = 5) -> Boosted:
    """Second-order boosting of the logistic loss over quantile bins; deterministic."""
    y = y.astype(float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Boosted(float(np.log(share / (1 - share))))
    if len(y) < 2 * least or y.min() == y.max():
        return model
    edges = []
    for column in x.T:
        values = np.unique(column)
        cuts = (values[1:] + values[:-1]) / 2
        edges.append(cuts if len(cuts) < BINS else np.unique(np.quantile(cuts, np.linspace(0, 1, BINS - 1))))
    binned = np.column_stack([np.searchsorted(c, column, side="left") for c, column in zip(edges, x.T, strict=True)])
    raw = np.full(len(y), model.prior)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        tree = _grow(binned, edges, p - y, p * (1 - p), depth, shrink, l2, least)
        model.trees.append(tree)
        raw = raw + tree.predict(x)
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on score by pooling adjacent violators, each block smoothed a little toward the mean."""
    # Rows of one score are one block from the start: taken one by one, those with label 0 would join the block below and tie it to the rest.
    values, at = np.unique(score, return_inverse=True)
    blocks: list[list[float]] = []
    for s, label, n in zip(values, np.bincount(at, y, len(values)), np.bincount(at, minlength=len(values)).astype(float), strict=True):
        blocks.append([label, n, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            label_sum, n, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + label_sum, blocks[-1][1] + n, blocks[-1][2], high]
    mean = float(np.mean(y)) if len(y) else 0.0
    knots = [(edge, (b[0] + mean) / (b[1] + 1)) for b in blocks for edge in dict.fromkeys(b[2:])]
    xs, ys = (np.array(v, dtype=float) for v in zip(*knots, strict=True)) if knots else (np.zeros(1), np.zeros(1))
    return xs, np.maximum.accumulate(ys)
