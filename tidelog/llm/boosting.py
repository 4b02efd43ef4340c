"""Gradient-boosted trees: fitted on a bounded labelled sample, evaluated as a Spark column.

Fitting is NumPy on the driver over at most `MAX_ROWS` rows. The fitted trees become nested CASE
expressions, so scoring all rows needs no user function.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ROWS = 20_000


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    below: Node | None = None
    above: Node | None = None


@dataclass
class Model:
    features: list[str]
    base: float
    trees: list[Node] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += _predict(t, x)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.shift)))

    def sql(self, prefix: str = "") -> str:
        """The calibrated probability as an SQL expression over fields named like the features, after `prefix`."""
        total = " + ".join([_number(self.base), *(_sql(t, self.features, prefix) for t in self.trees)])
        return f"(1D / (1D + exp(-(({total}) * {_number(self.slope)} + {_number(self.shift)}))))"

    def column(self) -> Column:
        """The calibrated probability of rows with a column for each feature."""
        return F.expr(self.sql())


def _number(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def _predict(t: Node, x: np.ndarray) -> np.ndarray:
    if t.below is None:
        return np.full(len(x), t.value)
    low = x[:, t.feature] <= t.cut
    return np.where(low, _predict(t.below, x), _predict(t.above, x))


def _sql(t: Node, names: Sequence[str], prefix: str) -> str:
    if t.below is None:
        return _number(t.value)
    return f"CASE WHEN {prefix}`{names[t.feature]}` <= {_number(t.cut)} THEN {_sql(t.below, names, prefix)} ELSE {_sql(t.above, names, prefix)} END"


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, rate: float, l2: float) -> Node:
    leaf = Node(value=rate * grad.sum() / (hess.sum() + l2))
    if depth == 0 or len(x) < 20:
        return leaf
    best, where = 1e-6, None
    whole = grad.sum() ** 2 / (hess.sum() + l2)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        cuts = (values[1:] + values[:-1]) / 2
        for cut in cuts if len(cuts) <= 32 else np.quantile(cuts, np.linspace(0, 1, 32)):
            low = x[:, j] <= cut
            if not 5 <= low.sum() <= len(x) - 5:
                continue
            gain = grad[low].sum() ** 2 / (hess[low].sum() + l2) + grad[~low].sum() ** 2 / (hess[~low].sum() + l2) - whole
            if gain > best:
                best, where = gain, (j, float(cut), low)
    if where is None:
        return leaf
    j, cut, low = where
    return Node(0.0, j, cut, _grow(x[low], grad[low], hess[low], depth - 1, rate, l2), _grow(x[~low], grad[~low], hess[~low], depth - 1, rate, l2))


def fit(x: np.ndarray, y: np.ndarray, features: list[str], trees: int = 20, depth: int = 3, rate: float = 0.3, l2: float = 1.0, held_out: float = 0.3, seed: int = 7) -> tuple[Model, np.ndarray]:
    """Fit on one part and calibrate (a logistic of the margin) on the held-out rest; gives the held-out row numbers too."""
    if len(x) > MAX_ROWS:
        raise ValueError(f"at most {MAX_ROWS} labelled rows")
    order = np.random.default_rng(seed).permutation(len(x))
    rest, own = order[: int(held_out * len(x))], order[int(held_out * len(x)) :]
    xs, ys = x[own], y[own].astype(float)
    rate0 = min(max(ys.mean(), 1e-3), 1 - 1e-3)
    model = Model(features, math.log(rate0 / (1 - rate0)))
    margin = np.full(len(xs), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(xs, ys - p, p * (1 - p), depth, rate, l2)
        model.trees.append(tree)
        margin += _predict(tree, xs)
    z, target = model.margin(x[rest]), (y[rest].astype(float) * (len(rest) - 2) + 1) / len(rest)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of Platt's logistic
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((target - p) * z).sum(), (target - p).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-8:
            break
    model.slope, model.shift = float(a), float(b)
    return model, rest


def threshold(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The smallest probability from which the held-out precision is at least as given; 0.99 if none is."""
    for p in np.unique(probability):
        if y[probability >= p].mean() >= precision:
            return float(max(p, 0.5))
    return 0.99
