"""Gradient-boosted trees that are trained on the driver from a bounded labelled sample and run as SQL expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A node is (feature, threshold, left, right), taking left where feature <= threshold; a leaf is a float.
Node = "tuple | float"


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, rate: float) -> Node:
    leaf = float(round(rate * grad.sum() / (hess.sum() + 1.0), 6))
    if depth == 0 or len(grad) < 8:
        return leaf
    best, total_g, total_h = (1e-6, None), grad.sum(), hess.sum()
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v = x[order, k]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        g, h = np.cumsum(grad[order])[cut], np.cumsum(hess[order])[cut]
        gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = (gain[at], (k, float(round((v[cut[at]] + v[cut[at] + 1]) / 2, 6))))
    if best[1] is None:
        return leaf
    k, threshold = best[1]
    left = x[:, k] <= threshold
    if left.all() or not left.any():
        return leaf
    return k, threshold, _grow(x[left], grad[left], hess[left], depth - 1, rate), _grow(x[~left], grad[~left], hess[~left], depth - 1, rate)


def _value(node: Node, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), node)
    k, threshold, left, right = node
    return np.where(x[:, k] <= threshold, _value(left, x), _value(right, x))


class Boosted:
    """Logistic boosting of shallow trees; the same trees give scores in numpy and as SQL."""

    def __init__(self, names: list[str], trees: int = 24, depth: int = 3, rate: float = 0.3) -> None:
        self.names, self.size, self.depth, self.rate = names, trees, depth, rate
        self.trees: list = []
        self.cut = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        score = np.zeros(len(y))
        for _ in range(self.size):
            p = 1 / (1 + np.exp(-score))
            tree = _grow(x, y - p, p * (1 - p), self.depth, self.rate)
            self.trees.append(tree)
            score += _value(tree, x)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return sum((_value(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float) -> Boosted:
        """Sets the least cut, at even odds or above, at which held-out rows that are selected are right this often."""
        score = self.score(x)
        order = np.argsort(-score, kind="stable")
        right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(right >= precision)
        if not len(good):
            self.cut = float("inf")
            return self
        at, ranked = good[-1], score[order]
        self.cut = max(0.0, float(round((ranked[at] + (ranked[at + 1] if at + 1 < len(ranked) else ranked[at] - 1)) / 2, 6)))
        return self

    def sql(self, columns: dict[str, str] | None = None) -> str:
        """The score as an expression over columns named like the features, or over the given expressions."""
        names = [(columns or {}).get(n, n) for n in self.names]

        def of(node: Node) -> str:
            if not isinstance(node, tuple):
                return f"CAST({node:.6f} AS DOUBLE)"
            k, threshold, left, right = node
            return f"CASE WHEN {names[k]} <= {threshold:.6f} THEN {of(left)} ELSE {of(right)} END"

        return " + ".join(f"({of(t)})" for t in self.trees) or "CAST(0 AS DOUBLE)"


def sample(labelled: DataFrame, most: int, seed: int) -> tuple[list, list]:
    """At most `most` rows of a labelled table to train on and as many to calibrate on: those with the least seeded hash of all columns, dealt out in turn."""
    h = F.xxhash64(F.lit(seed), *labelled.columns)
    rows = labelled.withColumn("_op_h", h).orderBy("_op_h").limit(2 * most).drop("_op_h").collect()
    return rows[::2], rows[1::2]
