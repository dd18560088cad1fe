"""Gradient-boosted regression trees for small feature tables, and their form as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float, rate: float) -> Node:
    """The tree that best lowers the second-order loss, by exact cuts between distinct values."""
    node = Node(-rate * g.sum() / (h.sum() + ridge))
    if depth == 0:
        return node
    best, whole = 1e-6, g.sum() ** 2 / (h.sum() + ridge)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero((v[1:] != v[:-1]) & (hs[:-1] >= least) & (hs[-1] - hs[:-1] >= least))
        if len(at) == 0:
            continue
        gain = gs[at] ** 2 / (hs[at] + ridge) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + ridge) - whole
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, node.feature, node.cut = gain[k], f, float(v[at[k]] + v[at[k] + 1]) / 2
    if node.feature >= 0:
        low = x[:, node.feature] <= node.cut
        node.low = _grow(x[low], g[low], h[low], depth - 1, least, ridge, rate)
        node.high = _grow(x[~low], g[~low], h[~low], depth - 1, least, ridge, rate)
    return node


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, least: float = 2.0, ridge: float = 1.0) -> tuple[float, list[Node]]:
    """Prior log odds and the trees of a logistic model."""
    share = np.clip(y.mean(), 0.01, 0.99)
    prior = float(np.log(share / (1 - share)))
    raw, out = np.full(len(y), prior), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        out.append(_grow(x, p - y, p * (1 - p), depth, least, ridge, rate))
        raw += predict(out[-1], x)
    return prior, out


def predict(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.cut, predict(node.low, x), predict(node.high, x))


def probability(model: tuple[float, list[Node]], x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(model[0] + sum(predict(t, x) for t in model[1]))))


def as_column(model: tuple[float, list[Node]], features: list[Column]) -> Column:
    """The model's probability as an expression over the feature columns."""

    def branch(node: Node) -> Column:
        if node.feature < 0:
            return F.lit(float(node.value))
        return F.when(features[node.feature] <= float(node.cut), branch(node.low)).otherwise(branch(node.high))

    total = F.lit(float(model[0]))
    for tree in model[1]:
        total = total + branch(tree)
    return 1 / (1 + F.exp(-total))
