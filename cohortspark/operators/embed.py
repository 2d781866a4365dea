"""Embeddings of slices by a frozen backbone: the contract of backbones, and one that needs no weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.operators import voxels
from cohortspark.plans.shared import ship


@dataclass(frozen=True)
class Backbone:
    """Declared properties of a backbone and how a task builds it: `build()` gives a function from (n, 3, h, w) to (n, dim)."""

    name: str
    dim: int
    input_size: int
    build: Callable[[], Callable[[np.ndarray], np.ndarray]]


def random_projection(dim: int, input_size: int, seed: int = 0) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A fixed random projection: keeps distances, knows nothing of images. Stands in where no weights are at hand."""

    def build() -> Callable[[np.ndarray], np.ndarray]:
        matrix = np.random.default_rng(seed).normal(size=(3 * input_size * input_size, dim)) / np.sqrt(3.0 * input_size * input_size)
        return lambda batch: batch.reshape(len(batch), -1) @ matrix

    return build


REGISTRY = {"projection_64": Backbone("projection_64", 64, 8, random_projection(64, 8)), "projection_512": Backbone("projection_512", 512, 16, random_projection(512, 16))}


#: Backbones with pretrained weights, their dimensions and input size. Their weights aren't here: register one with
#: `register`, giving the function that builds it.
PRETRAINED = {"resnet18": (512, 224), "resnet50": (2048, 224), "efficientnet_b0": (1280, 224), "convnext_tiny": (768, 224), "densenet121": (1024, 224)}


def register(name: str, build: Callable[[], Callable[[np.ndarray], np.ndarray]], dim: int | None = None, input_size: int | None = None) -> Backbone:
    """Adds a backbone; dimensions of known ones are as declared above, those of others must be given."""
    known = PRETRAINED.get(name, (dim, input_size))
    if None in known:
        raise ValueError("dim and input_size must be given")
    REGISTRY[name] = Backbone(name, *known, build)
    return REGISTRY[name]


def backbone(name: str) -> Backbone:
    if name not in REGISTRY:
        raise ValueError(f"backbone must be one of {sorted(REGISTRY)}")
    return REGISTRY[name]


def resize(batch: np.ndarray, size: int) -> np.ndarray:
    """Bilinear, pixel centres aligned as image libraries do."""
    n, c, h, w = batch.shape
    if (h, w) == (size, size):
        return batch

    def axis(old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(size) + 0.5) * old / size - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, old - 1), at - low

    (r0, r1, fr), (c0, c1, fc) = axis(h), axis(w)
    rows = batch[:, :, r0] * (1 - fr)[None, None, :, None] + batch[:, :, r1] * fr[None, None, :, None]
    return rows[..., c0] * (1 - fc) + rows[..., c1] * fc


def embed_cohort(volumes: DataFrame, keep: list[str], spec: Backbone, axis: int = 1, n: int = 5, step: int = 4, mode: str = "adjacent") -> DataFrame:
    """One row per volume and slice position: the `keep` columns, position, embedding. RuntimeError for a wrong dimension.

    Slices and channels are array expressions; the backbone is built once per task and sees whole Arrow batches.
    """
    ship(volumes.sparkSession)
    shape2 = voxels.plane_shape(F.col("shape"), axis)
    samples = volumes.select(*keep, shape2.alias("_size"), F.inline(voxels.subject_samples(F.col("data"), F.col("shape"), axis, n, step, mode)))
    samples = samples.withColumn("channels", voxels.standardize_channels(F.col("channels")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = spec.build()
        for batch in batches:
            images = [resize(np.stack([np.asarray(c, dtype=float) for c in ch]).reshape(1, 3, *size), spec.input_size)[0] for ch, size in zip(batch["channels"], batch["_size"])]
            out = model(np.stack(images)) if images else np.zeros((0, spec.dim))
            if out.shape[1] != spec.dim:
                raise RuntimeError(f"{spec.name} declares {spec.dim} dimensions and gives {out.shape[1]}")
            yield batch[[*keep, "position"]].assign(embedding=list(out))

    kept = [f for f in samples.schema.fields if f.name in keep]
    schema = T.StructType([*sorted(kept, key=lambda f: keep.index(f.name)), T.StructField("position", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    return samples.mapInPandas(run, schema)


def embedding_columns(columns: list[str], prefix: str = "emb_") -> list[str]:
    """Wide embedding columns in the order of their numbers."""
    return sorted((c for c in columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))


def widen(df: DataFrame, dim: int, column: str = "embedding", prefix: str = "emb_") -> DataFrame:
    return df.select(*[c for c in df.columns if c != column], *[F.get(column, F.lit(i)).alias(f"{prefix}{i}") for i in range(dim)])
