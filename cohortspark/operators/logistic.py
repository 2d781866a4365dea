"""Standardised, class-balanced, L2-regularised logistic regression: one fit of rows in memory, as NumPy.

For one large fit use `fit_large`, which is Spark ML with the same objective; the fits of cross-validation are in `fits`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Recipe:
    """What is fitted: strength c (smaller is stronger), k best features, components of trailing columns.

    `keep` leading columns bypass the components; None for k or components means all columns as they are.
    """

    c: float = 1.0
    k: int | None = None
    components: int | None = None
    keep: int = 0

    def __post_init__(self) -> None:
        if self.c <= 0:
            raise ValueError("c must be positive")


def univariate_f(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Two-class analysis of variance, per column."""
    groups = [x[y == v] for v in np.unique(y)]
    mean = x.mean(axis=0)
    between = sum(len(g) * (g.mean(axis=0) - mean) ** 2 for g in groups) / (len(groups) - 1)
    within = sum(((g - g.mean(axis=0)) ** 2).sum(axis=0) for g in groups) / max(1, len(x) - len(groups))
    return np.divide(between, within, out=np.zeros_like(between), where=within > 0)


def newton(x: np.ndarray, y: np.ndarray, c: float, steps: int = 100, tolerance: float = 1e-10) -> np.ndarray:
    """Weights and intercept that minimise |w|²/2 + c * sum of class-balanced losses; the intercept is free."""
    n, d = x.shape
    weight = np.where(y == 1, n / (2 * max(1, (y == 1).sum())), n / (2 * max(1, (y == 0).sum())))
    design = np.hstack([x, np.ones((n, 1))])
    penalty = np.append(np.ones(d), 0.0)
    w = np.zeros(d + 1)

    def loss(v: np.ndarray) -> float:
        z = design @ v
        return 0.5 * (penalty * v * v).sum() + c * (weight * (np.logaddexp(0, z) - y * z)).sum()

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        gradient = penalty * w + c * design.T @ (weight * (p - y))
        hessian = np.diag(penalty + 1e-12) + c * (design.T * (weight * p * (1 - p))) @ design
        step = np.linalg.solve(hessian, gradient)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(gradient).max() < tolerance * max(1.0, n):
            break
    return w


class Model:
    """A fitted recipe. Everything it knows comes from its training rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, recipe: Recipe):
        if len(np.unique(y)) < 2:
            raise ValueError("training rows hold a single class")
        self.mean, std = x.mean(axis=0), x.std(axis=0)
        self.std = np.where(std == 0, 1.0, std)
        z = (x - self.mean) / self.std
        self.columns = np.arange(x.shape[1])
        if recipe.k is not None and recipe.k < x.shape[1]:
            self.columns = np.sort(np.argsort(-univariate_f(z, y), kind="stable")[: recipe.k])
        z = z[:, self.columns]
        self.keep, self.basis = recipe.keep, None
        if recipe.components is not None and z.shape[1] - self.keep > recipe.components:
            tail = z[:, self.keep :]
            self.basis = np.linalg.svd(tail - tail.mean(axis=0), full_matrices=False)[2][: recipe.components].T
        self.weights = newton(self._project(z), y, recipe.c)

    def _project(self, z: np.ndarray) -> np.ndarray:
        return z if self.basis is None else np.hstack([z[:, : self.keep], z[:, self.keep :] @ self.basis])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        z = self._project(((x - self.mean) / self.std)[:, self.columns])
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -500, 500)))


def fit_large(df: DataFrame, features: list[str], label: str = "label", c: float = 1.0) -> dict:
    """The same objective over rows of any number: mean, std, coefficients and intercept in terms of standardised features."""
    stats = df.agg(F.count("*").alias("n"), F.sum(label).alias("p"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    n, p = stats["n"], stats["p"]
    if not p or p == n:
        raise ValueError("training rows hold a single class")
    mean, std = [stats[f"m_{f}"] for f in features], [stats[f"s_{f}"] or 1.0 for f in features]
    scaled = df.select(
        array_to_vector(F.array(*[(F.col(f) - m) / s for f, m, s in zip(features, mean, std)])).alias("features"), F.col(label).cast("double").alias("label"),
        F.when(F.col(label) == 1, n / (2 * p)).otherwise(n / (2 * (n - p))).alias("w"),
    )
    model = LogisticRegression(regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, weightCol="w", maxIter=200, tol=1e-10).fit(scaled)
    return {"features": features, "mean": mean, "std": std, "coefficients": model.coefficients.toArray().tolist(), "intercept": float(model.intercept)}


def linear_score(model: dict) -> Column:
    """Probability of class 1 under a model of `fit_large`, as one JVM expression."""
    z = F.lit(float(model["intercept"]))
    for name, mean, std, w in zip(model["features"], model["mean"], model["std"], model["coefficients"]):
        z = z + (F.col(name) - mean) / std * w
    return 1 / (1 + F.exp(-z))
