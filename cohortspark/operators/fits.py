"""Many logistic fits at once, each over other folds of the same rows: Newton's method on sums that Spark adds up.

No task holds more rows than an Arrow batch; the driver holds sums, whose size is that of folds, recipes and columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.logistic import Recipe
from cohortspark.plans.shared import ship


def _totals(rows: DataFrame, measure: Callable[[np.ndarray, np.ndarray, np.ndarray], dict], combine: dict | None = None) -> dict[int, np.ndarray]:
    """Per key the sum over all rows (fold, _x, _y) of the vectors that `measure` gives for a batch; or the `combine` of the key."""
    ship(rows.sparkSession)
    combine = combine or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for key, v in measure(x, batch.column("_y").to_numpy(), batch.column("fold").to_numpy()).items():
                    total[key] = v if key not in total else combine.get(key, np.add)(total[key], v)
        for key, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), key, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v.astype(float))], ["key", "at", "v"])

    parts = rows.select("fold", "_x", "_y").mapInArrow(run, "key int, at int, v double").groupBy("key", "at").agg(F.sum("v").alias("add"), F.min("v").alias("minimum"), F.max("v").alias("maximum")).toPandas()
    parts = parts.sort_values(["key", "at"])
    return {int(k): g[getattr(combine.get(k, np.add), "__name__")].to_numpy() for k, g in parts.groupby("key")}


class _Part:
    """Counts, sums, products and ranges of scaled columns over some rows."""

    def __init__(self, n: float, total: np.ndarray, product: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.n, self.total, self.product, self.low, self.high = n, total, product, low, high

    def __add__(self, o: _Part) -> _Part:
        return _Part(self.n + o.n, self.total + o.total, self.product + o.product, np.minimum(self.low, o.low), np.maximum(self.high, o.high))


def _parts(rows: DataFrame, folds: list[int], center: np.ndarray, scale: np.ndarray) -> dict[tuple[int, int], _Part]:
    """By fold and class; only those that have rows."""
    d = len(center)
    upper = np.triu_indices(d)
    cells = [(f, y) for f in folds for y in (0, 1)]

    def measure(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> dict:
        out, u = {}, (x - center) / scale
        for i, (f, c) in enumerate(cells):
            v = u[(fold == f) & (y == c)]
            if len(v):
                out |= {3 * i: np.concatenate([[len(v)], v.sum(0), (v.T @ v)[upper]]), 3 * i + 1: v.min(0), 3 * i + 2: v.max(0)}
        return out

    sums = _totals(rows, measure, {3 * i + j: g for i in range(len(cells)) for j, g in ((1, np.minimum), (2, np.maximum))})
    found = {}
    for i, cell in enumerate(cells):
        if 3 * i in sums:
            product = np.zeros((d, d))
            product[upper] = sums[3 * i][1 + d :]
            found[cell] = _Part(sums[3 * i][0], sums[3 * i][1 : 1 + d], product + np.triu(product, 1).T, sums[3 * i + 1], sums[3 * i + 2])
    return found


def _design(parts: list[_Part], recipe: Recipe) -> np.ndarray:
    """What takes scaled columns and a 1 to the recipe's inputs and a 1, as learned from the rows of the two classes."""
    whole = parts[0] + parts[1]
    d, n = len(whole.total), whole.n
    constant = whole.low == whole.high
    mean = np.where(constant, whole.low, whole.total / n)
    variance = np.where(constant, 0, np.maximum(0, np.diag(whole.product) / n - mean**2))
    std = np.sqrt(np.where(variance > 0, variance, 1.0))
    columns = np.arange(d)
    if recipe.k is not None and recipe.k < d:
        within = sum(np.where(p.low == p.high, 0, np.maximum(0, np.diag(p.product) - p.total**2 / p.n)) for p in parts) / max(1, n - 2)
        between = sum(p.n * (p.total / p.n - mean) ** 2 for p in parts)
        f = np.divide(between, within, out=np.zeros(d), where=(within > 0) & ~constant)
        columns = np.sort(np.argsort(-f, kind="stable")[: recipe.k])
    basis = np.eye(len(columns))
    if recipe.components is not None and len(columns) - recipe.keep > recipe.components:
        tail = columns[recipe.keep :]
        spread = (whole.product / n - np.outer(mean, mean))[np.ix_(tail, tail)] / np.outer(std[tail], std[tail])
        spread[constant[tail]], spread[:, constant[tail]] = 0, 0
        vectors = np.linalg.eigh(spread)[1][:, ::-1][:, : recipe.components]
        basis = np.zeros((len(columns), recipe.keep + recipe.components))
        basis[: recipe.keep, : recipe.keep], basis[recipe.keep :, recipe.keep :] = np.eye(recipe.keep), vectors
    out = np.zeros((basis.shape[1] + 1, d + 1))
    out[:-1, columns] = basis.T / std[columns]
    out[:-1, -1] = -out[:-1, :-1] @ mean
    out[-1, -1] = 1
    return out


class _Newton:
    """One fit's state between passes: the weights to try next, and what is known at the last ones that were kept."""

    def __init__(self, design: np.ndarray, c: float, n: float):
        q = len(design)
        self.c, self.n, self.penalty, self.upper = c, n, np.append(np.ones(q - 1), 0.0), np.triu_indices(q)
        self.w = self.kept = np.zeros(q)
        self.loss, self.size, self.step, self.done = np.inf, 1.0, np.zeros(q), False

    def take(self, sums: np.ndarray, tolerance: float) -> None:
        """`sums` at `w`: loss, gradient, upper half of the curvature, of the weighted rows."""
        q = len(self.w)
        loss = 0.5 * (self.penalty * self.w * self.w).sum() + self.c * sums[0]
        if loss > self.loss + 1e-13 * abs(self.loss) and self.size > 1e-6:
            self.size /= 2
            self.w = self.kept - self.size * self.step
            return
        gradient = self.penalty * self.w + self.c * sums[1 : 1 + q]
        curve = np.zeros((q, q))
        curve[self.upper] = self.c * sums[1 + q :]
        curve = curve + np.triu(curve, 1).T + np.diag(self.penalty + 1e-12)
        self.kept, self.loss, self.size, self.step = self.w, loss, 1.0, np.linalg.solve(curve, gradient)
        self.done = bool(np.abs(gradient).max() < tolerance * max(1.0, self.n))
        self.w = self.kept - self.step


def fit_folds(rows: DataFrame, folds: list[int], fits: list[tuple[frozenset[int], Recipe]], steps: int = 100, tolerance: float = 1e-10) -> tuple[np.ndarray, list[tuple[np.ndarray, float]]]:
    """Each fit's recipe learned from the rows (fold, _x, _y) outside its folds; the same minimum as `logistic.Model`.

    Gives a center, and per fit weights and intercept: the score's logit is weights · (x - center) + intercept.
    """
    d = rows.select(F.size("_x")).first()[0]
    moments = rows.agg(*[g(F.get("_x", F.lit(i))) for g in (F.avg, F.stddev_pop) for i in range(d)]).first()
    center, scale = np.array(moments[:d]), np.array([s or 1.0 for s in moments[d:]])
    parts = _parts(rows, folds, center, scale)
    designs, states, weights = [], [], []
    for out, recipe in fits:
        both = []
        for y in (0, 1):
            own = [parts[f, y] for f in folds if f not in out and (f, y) in parts]
            if not own:
                raise ValueError("training rows hold a single class")
            both.append(sum(own[1:], own[0]))
        n = both[0].n + both[1].n
        designs.append(_design(both, recipe))
        states.append(_Newton(designs[-1], recipe.c, n))
        weights.append([n / (2 * p.n) for p in both])
    for _ in range(steps):
        # plain values, so that tasks get no classes
        todo = [(i, sorted(fits[i][0]), designs[i], weights[i], s.w, s.upper) for i, s in enumerate(states) if not s.done]
        if not todo:
            break

        def measure(x: np.ndarray, y: np.ndarray, fold: np.ndarray, todo: list = todo) -> dict:
            u, result = np.hstack([(x - center) / scale, np.ones((len(x), 1))]), {}
            for i, left_out, design, by_class, w, upper in todo:
                used = ~np.isin(fold, left_out)
                if used.any():
                    f, t = u[used] @ design.T, y[used]
                    z = f @ w
                    p, weight = 1 / (1 + np.exp(-np.clip(z, -500, 500))), np.where(t == 1, by_class[1], by_class[0])
                    loss = (weight * (np.logaddexp(0, z) - t * z)).sum()
                    result[i] = np.concatenate([[loss], f.T @ (weight * (p - t)), ((f.T * (weight * p * (1 - p))) @ f)[upper]])
            return result

        for i, sums in _totals(rows, measure).items():
            states[i].take(sums, tolerance)
    found = []
    for design, s in zip(designs, states):
        linear = s.w @ design
        found.append((linear[:-1] / scale, float(linear[-1])))
    return center, found
