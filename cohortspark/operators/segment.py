"""Three-class segmentation of volumes: a mixture of three Gaussians over the intensities of each brain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortspark.plans.shared import ship

MAX_SAMPLES = 50_000


def fit_mixture(values: np.ndarray, seed: int = 42, max_samples: int = MAX_SAMPLES, steps: int = 200, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, variances) of three components by expectation-maximisation, darkest first.

    Starts from thirds of the sorted values; more than `max_samples` values are sampled without replacement.
    """
    if len(values) < 3:
        raise ValueError("a mixture of three needs three voxels")
    x = values.astype(float)
    if len(x) > max_samples:
        x = np.random.default_rng(seed).choice(x, max_samples, replace=False)
    thirds = np.array_split(np.sort(x), 3)
    weight, mean, var = np.full(3, 1 / 3), np.array([t.mean() for t in thirds]), np.array([max(t.var(), 1e-6) for t in thirds])
    before = -np.inf
    for _ in range(steps):
        log = np.log(weight) - 0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mean) ** 2 / var)
        top = log.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
        part = np.exp(log - total[:, None])
        n = part.sum(axis=0) + 1e-12
        weight, mean = n / n.sum(), (part * x[:, None]).sum(axis=0) / n
        var = np.maximum((part * (x[:, None] - mean) ** 2).sum(axis=0) / n, 1e-6)
        if abs(total.mean() - before) < tolerance * 1e-3:
            break
        before = total.mean()
    order = np.argsort(mean)
    return weight[order], mean[order], var[order]


def segment(volume: np.ndarray, seed: int = 42, max_samples: int = MAX_SAMPLES) -> np.ndarray:
    """0 where the volume is 0 or less, else 1 to 3 from dark to bright; an empty brain is all 0."""
    out = np.zeros(len(volume), dtype=np.int16)
    inside = volume > 0
    if inside.sum() < 3:
        return out
    x = volume[inside].astype(float)
    weight, mean, var = fit_mixture(x, seed, max_samples)
    log = np.log(weight) - 0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mean) ** 2 / var)
    out[inside] = log.argmax(axis=1) + 1
    return out


def segment_volumes(volumes: DataFrame, data: str = "data", name: str = "seg", seed: int = 42, max_samples: int = MAX_SAMPLES) -> DataFrame:
    """`volumes` with a segmentation of each; a volume stays in its task, nothing is shuffled."""
    ship(volumes.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[name] = [None if v is None else segment(np.asarray(v, dtype=float), seed, max_samples) for v in batch[data]]
            yield batch

    schema = T.StructType([f for f in volumes.schema.fields if f.name != name] + [T.StructField(name, T.ArrayType(T.ShortType()))])
    return volumes.select(*[f.name for f in schema.fields[:-1]]).mapInPandas(run, schema)
