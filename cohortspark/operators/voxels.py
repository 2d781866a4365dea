"""Voxel arrays: a volume is `data` (array of numbers in C order) with its `shape` (three sizes).

Everything here stays with the row, so a volume is never exploded or shuffled: what touches a plane is an expression over
arrays, what touches every voxel is NumPy in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortspark.functions.arrays import mapped

CHANNEL_MODES = ("replicate", "adjacent")
#: Mean and standard deviation of the three channels that pretrained image models expect.
CHANNEL_MEAN, CHANNEL_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def squeeze(shape: Column) -> Column:
    """The shape without trailing sizes of 1 beyond the third; a real fourth dimension stays."""
    last_real = F.array_max(F.transform(shape, lambda x, i: F.when((x != 1) | (i < 3), i + 1).otherwise(0)))
    return F.slice(shape, 1, last_real)


def require_volume(shape: Column) -> Column:
    """The squeezed shape; raises where it hasn't three dimensions."""
    squeezed = squeeze(shape)
    return F.when(F.size(squeezed) == 3, squeezed).otherwise(F.raise_error(F.concat(F.lit("expected 3 dimensions, got "), F.size(squeezed).cast("string"))))


def plane_shape(shape: Column, axis: int) -> Column:
    return F.array(*[F.get(shape, F.lit(i)) for i in range(3) if i != axis])


def plane(data: Column, shape: Column, axis: int, index: Column | int) -> Column:
    """Plane `index` of an axis (0, 1, 2) as an array in C order; raises for an index outside the volume."""
    if axis not in (0, 1, 2):
        raise ValueError("axis must be 0, 1 or 2")
    at = index if isinstance(index, Column) else F.lit(index)
    x, y, z = (F.get(shape, F.lit(i)) for i in range(3))
    pick = {
        0: lambda i: at * y * z + i,
        1: lambda i: F.expr("0") + F.floor(i / z) * y * z + at * z + i % z,
        2: lambda i: i * z + at,
    }[axis]
    size = {0: y * z, 1: x * z, 2: x * y}[axis]
    good = (at >= 0) & (at < F.get(shape, F.lit(axis)))
    cells = F.transform(F.sequence(F.lit(0), (size - 1).cast("int")), lambda i: F.get(data, pick(i).cast("int")))
    return F.when(good, cells).otherwise(F.raise_error(F.lit(f"plane index outside axis {axis}")))


def central_indices(size: Column, n: int, step: int = 1) -> Column:
    """Indices of `n` planes around the middle, `step` apart; raises where one lies outside."""
    first = F.floor(size / 2).cast("int") - (n - 1) * step // 2
    good = (first >= 0) & (first + (n - 1) * step < size)
    return F.when(good, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: first + i * step)).otherwise(F.raise_error(F.lit(f"{n} planes {step} apart don't fit")))


def central_planes(data: Column, shape: Column, axis: int, n: int, step: int = 1) -> Column:
    """array of struct(position, plane); explode it for one row per position."""
    positions = central_indices(F.get(shape, F.lit(axis)), n, step)
    return F.transform(positions, lambda p: F.struct(p.alias("position"), plane(data, shape, axis, p).alias("plane")))


def _clip(low: float, high: float) -> Callable[[np.ndarray], np.ndarray]:
    if not 0 <= low < high <= 100:
        raise ValueError("bounds must satisfy 0 <= low < high <= 100")

    def clip(v: np.ndarray) -> np.ndarray:
        bounds = np.percentile(v, [low, high], axis=1)
        return np.clip(v, bounds[0][:, None], bounds[1][:, None])

    return clip


def _minmax(v: np.ndarray) -> np.ndarray:
    low, high = v.min(axis=1, keepdims=True), v.max(axis=1, keepdims=True)
    return np.divide(v - low, high - low, out=np.zeros_like(v), where=high > low)


def _zscore(v: np.ndarray, foreground_only: bool = True) -> np.ndarray:
    used = v > 0 if foreground_only else np.ones(v.shape, bool)
    n = np.maximum(used.sum(axis=1, keepdims=True), 1)
    mean = v.sum(axis=1, where=used, keepdims=True) / n
    sd = np.sqrt(np.square(v - mean).sum(axis=1, where=used, keepdims=True) / n)
    return np.divide(v - mean, sd, out=np.zeros_like(v), where=sd > 0)


def clip_percentile(data: Column, low: float = 1, high: float = 99) -> Column:
    """Values cut off at two exact percentiles of all voxels, interpolated linearly. Not-a-number anywhere makes all of it."""
    return mapped(data, _clip(low, high))


def minmax(data: Column) -> Column:
    """Scaled to [0, 1]; zeros where all values are equal."""
    return mapped(data, _minmax)


def zscore(data: Column, foreground_only: bool = True) -> Column:
    """Standardised by mean and population std of the values above 0, applied to all; zeros where these don't exist."""
    return mapped(data, lambda v: _zscore(v, foreground_only))


SCHEMES = {"minmax": _minmax, "zscore": _zscore}


def preprocess(data: Column, scheme: str = "minmax", low: float = 1, high: float = 99) -> Column:
    """Cut off, then scaled, in one pass over the voxels."""
    if scheme not in SCHEMES:
        raise ValueError(f"scheme must be one of {sorted(SCHEMES)}")
    clip, scale = _clip(low, high), SCHEMES[scheme]
    return mapped(data, lambda v: scale(clip(v)))


def channel_indices(center: Column, mode: str, size: Column, gap: int = 1) -> Column:
    """Planes of the three channels around `center`: the same thrice, or its neighbours within the volume."""
    if mode not in CHANNEL_MODES:
        raise ValueError(f"mode must be one of {CHANNEL_MODES}")
    three = F.array(center, center, center) if mode == "replicate" else F.array(F.greatest(F.lit(0), center - gap), center, F.least(size - 1, center + gap))
    return F.when((center >= 0) & (center < size), three).otherwise(F.raise_error(F.lit("center outside the axis")))


def axis_sample(data: Column, shape: Column, center: Column, axis: int = 1, mode: str = "replicate", gap: int = 1) -> Column:
    """Three channels, each a plane of one axis."""
    return F.transform(channel_indices(center, mode, F.get(shape, F.lit(axis)), gap), lambda c: plane(data, shape, axis, c))


def pad_to_square(cells: Column, shape2: Column, size: Column) -> Column:
    """A plane in the middle of a square of zeros; raises where it is larger than the square."""
    h, w = F.get(shape2, F.lit(0)), F.get(shape2, F.lit(1))
    top, left = F.floor((size - h) / 2), F.floor((size - w) / 2)

    def cell(i: Column) -> Column:
        r, c = F.floor(i / size) - top, i % size - left
        inside = (r >= 0) & (r < h) & (c >= 0) & (c < w)
        return F.when(inside, F.get(cells, (r * w + c).cast("int")).cast("double")).otherwise(0.0)

    square = F.transform(F.sequence(F.lit(0), (size * size - 1).cast("int")), cell)
    return F.when((h <= size) & (w <= size), square).otherwise(F.raise_error(F.lit("plane is larger than the square")))


def triplanar_offsets(n: int, step: int) -> list[int]:
    """Offsets from the middle; symmetric for odd n, one more above it for even n."""
    return [(i - (n - 1) // 2) * step for i in range(n)]


def triplanar_sample(data: Column, shape: Column, offset: int = 0) -> Column:
    """One plane per axis at its middle plus offset, each padded to the longest side."""
    side = F.array_max(shape)
    return F.array(*[
        pad_to_square(plane(data, shape, a, F.floor(F.get(shape, F.lit(a)) / 2).cast("int") + offset), plane_shape(shape, a), side) for a in range(3)
    ])


def subject_samples(data: Column, shape: Column, axis: int = 1, n: int = 5, step: int = 4, mode: str = "replicate", gap: int = 1) -> Column:
    """array of struct(position, channels): one row per position when exploded."""
    positions = central_indices(F.get(shape, F.lit(axis)), n, step)
    return F.transform(positions, lambda p: F.struct(p.alias("position"), axis_sample(data, shape, p, axis, mode, gap).alias("channels")))


def standardize_channels(channels: Column) -> Column:
    """Each of three channels less its mean, by its standard deviation."""
    mean, std = F.array(*map(F.lit, CHANNEL_MEAN)), F.array(*map(F.lit, CHANNEL_STD))
    scaled = F.transform(channels, lambda c, i: F.transform(c, lambda v: (v - F.get(mean, i)) / F.get(std, i)))
    return F.when(F.size(channels) == 3, scaled).otherwise(F.raise_error(F.lit("expected 3 channels")))


def foreground(data: Column, threshold: float = 0.0) -> Column:
    return F.transform(data, lambda v: v > threshold)
