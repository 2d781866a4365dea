"""Tissue, regional and asymmetry features of segmentations (labels 0 to 3 in a C-order array)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.arrays import counted

#: Labels of a segmentation.
TISSUES = {"background": 0, "csf": 1, "grey_matter": 2, "white_matter": 3}
BRAIN = ("csf", "grey_matter", "white_matter")
TISSUE_FEATURES = (
    "background_voxels", "csf_voxels", "grey_matter_voxels", "white_matter_voxels", "csf_fraction", "grey_matter_fraction", "white_matter_fraction",
    "gm_csf_ratio", "gm_wm_ratio", "brain_csf_ratio", "intracranial_voxels",
)


def _labels(seg: np.ndarray) -> np.ndarray:
    """Labels as whole numbers; ValueError for others than the known ones."""
    found = seg.astype(np.int64)
    if len(found) and (found.min() < 0 or found.max() >= len(TISSUES) or (found != seg).any()):
        raise ValueError("unknown label")
    return found


def tissue_counts(df: DataFrame, seg: str) -> DataFrame:
    """`df` with the voxels of each label; raises where another label occurs; null for a null segmentation."""
    counts = df.withColumn("_tissues", counted(lambda v: np.bincount(_labels(v), minlength=len(TISSUES)), F.col(seg)))
    return counts.withColumns({f"{name}_voxels": F.get("_tissues", F.lit(code)).cast("int") for name, code in TISSUES.items()}).drop("_tissues")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def tissue_features(df: DataFrame, seg: str = "seg") -> DataFrame:
    """`df` with the eleven tissue features; fractions are of the brain's voxels, and 0 where a denominator is."""
    counts = tissue_counts(df, seg)
    csf, gm, wm = (F.col(f"{t}_voxels") for t in BRAIN)
    brain = csf + gm + wm
    return counts.withColumns({
        "intracranial_voxels": brain,
        **{f"{t}_fraction": _ratio(F.col(f"{t}_voxels"), brain) for t in BRAIN},
        "gm_csf_ratio": _ratio(gm, csf), "gm_wm_ratio": _ratio(gm, wm), "brain_csf_ratio": _ratio(gm + wm, csf),
    })


def block_bounds(size: int, n: int) -> list[tuple[int, int]]:
    """`n` consecutive parts of an axis, as even as whole numbers allow."""
    if n < 1 or size < n:
        raise ValueError("an axis can't be cut into so many blocks")
    edges = [i * size // n for i in range(n + 1)]
    return list(zip(edges, edges[1:]))


def block_centre(shape: tuple[int, int, int], n: int, index: tuple[int, int, int]) -> tuple[int, ...]:
    return tuple((a + b) // 2 for a, b in (block_bounds(s, n)[i] for s, i in zip(shape, index)))


def _block_counter(n: int):
    """Of a segmentation and its shape the voxels by block and label."""

    def count(seg: np.ndarray, shape: np.ndarray) -> np.ndarray:
        sizes = [int(x) for x in shape[:3]]
        if min(sizes) < n:
            raise ValueError("an axis is shorter than the number of blocks")
        # block whose edges floor(i * size / n) hold a position
        i, j, k = (((np.arange(x) + 1) * n - 1) // x for x in sizes)
        block = (i[:, None, None] * n + j[:, None]) * n + k
        return np.bincount(block.ravel() * len(TISSUES) + _labels(seg), minlength=n**3 * len(TISSUES))

    return count


def block_counts(df: DataFrame, key: str, seg: str = "seg", shape: str = "shape", n: int = 4) -> DataFrame:
    """One row per volume and block (i, j, k): voxels of each brain tissue, and all voxels. Raises where an axis is too short.

    The counts are made within the volume's row, so only n³ short rows per volume leave it, never its voxels. A null
    segmentation gives none.
    """
    cells = df.select(key, counted(_block_counter(n), F.col(seg), F.col(shape)).alias("_c"))
    of = F.transform(F.sequence(F.lit(0), F.lit(n**3 - 1)), lambda b: F.slice("_c", b * len(TISSUES) + 1, len(TISSUES)))
    per = cells.where(F.col("_c").isNotNull()).select(key, F.posexplode(of).alias("block", "c"))
    return per.select(
        key, F.floor(F.col("block") / (n * n)).cast("int").alias("i"), (F.floor(F.col("block") / n) % n).cast("int").alias("j"), (F.col("block") % n).alias("k"), "c"
    ).select(
        key, "i", "j", "k", *[F.get("c", F.lit(TISSUES[t])).cast("int").alias(t) for t in BRAIN], F.aggregate("c", F.lit(0).cast("bigint"), lambda a, v: a + v).cast("int").alias("voxels")
    )


def regional_fractions(blocks: DataFrame, key: str) -> DataFrame:
    """Long form: (key, tissue, i, j, k, value), a tissue's part of the block's brain voxels; 0 in blocks without any."""
    brain = F.col("csf") + F.col("grey_matter") + F.col("white_matter")
    cells = F.array(*[F.struct(F.lit(t).alias("tissue"), _ratio(F.col(t), brain).alias("value")) for t in BRAIN])
    return blocks.select(key, "i", "j", "k", F.inline(cells)).select(key, "tissue", "i", "j", "k", "value")


def block_occupancy(blocks: DataFrame, key: str) -> DataFrame:
    """(key, i, j, k, value): the brain's part of all voxels of a block."""
    return blocks.select(key, "i", "j", "k", _ratio(F.col("csf") + F.col("grey_matter") + F.col("white_matter"), F.col("voxels")).alias("value"))


def asymmetry(fractions: DataFrame, key: str, n: int) -> DataFrame:
    """(key, tissue, i, j, k, value): a left block (i < n div 2) less its mirror image; the middle of an odd n is left out."""
    left = fractions.where(F.col("i") < n // 2)
    right = fractions.where(F.col("i") >= n - n // 2).select(key, "tissue", (n - 1 - F.col("i")).alias("i"), "j", "k", F.col("value").alias("right"))
    return left.join(right, [key, "tissue", "i", "j", "k"]).select(key, "tissue", "i", "j", "k", (F.col("value") - F.col("right")).alias("value"))


def regional_vector(blocks: DataFrame, key: str, n: int, occupancy: bool = True, asymmetric: bool = True) -> DataFrame:
    """One row per volume with a map of all regional features: `{tissue}_b{i}_{j}_{k}`, `asym_…`, `occupancy_…`."""
    fractions = regional_fractions(blocks, key)
    name = lambda prefix, t: F.format_string(f"{prefix}%s_b%d_%d_%d", t, "i", "j", "k")
    long = fractions.select(key, name("", F.col("tissue")).alias("name"), "value")
    if asymmetric:
        long = long.unionByName(asymmetry(fractions, key, n).select(key, name("asym_", F.col("tissue")).alias("name"), "value"))
    if occupancy:
        long = long.unionByName(block_occupancy(blocks, key).select(key, F.format_string("occupancy_b%d_%d_%d", "i", "j", "k").alias("name"), "value"))
    return long.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("features"))  # 7.5 n³ entries at most


def block_index(name: Column) -> Column:
    """struct(i, j, k) from the end of a feature's name; null where there is none."""
    part = lambda g: F.regexp_extract(name, r"_b(\d+)_(\d+)_(\d+)$", g)
    return F.when(part(1) != "", F.struct(*[part(g).cast("int").alias(c) for g, c in ((1, "i"), (2, "j"), (3, "k"))]))


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Voxels that both have, and that each has, of every tissue of the brain."""
    if len(a) != len(b):
        raise ValueError("segmentations differ in shape")
    size = len(TISSUES)
    table = np.bincount(_labels(a) * size + _labels(b), minlength=size * size).reshape(size, size)
    codes = [TISSUES[t] for t in BRAIN]
    return np.stack([table[codes, codes], table.sum(axis=1)[codes] + table.sum(axis=0)[codes]], axis=1).ravel()


def segmentation_agreement(df: DataFrame, ours: str, reference: str) -> DataFrame:
    """`df` with the overlap (dice) of each tissue in two segmentations; 1 where neither has it; raises where sizes differ."""
    both = df.withColumn("_o", counted(_overlap, F.col(ours), F.col(reference)))
    at = lambda i: F.get("_o", F.lit(i))
    dice = {f"dice_{t}": F.when(at(2 * i + 1) == 0, 1.0).otherwise(F.try_divide(2.0 * at(2 * i), at(2 * i + 1))) for i, t in enumerate(BRAIN)}
    return both.withColumns(dice).drop("_o")


def near_constant(df: DataFrame, columns: list[str], least_std: float = 1e-9) -> list[str]:
    """Columns whose sample standard deviation is at most `least_std` (or doesn't exist), by one aggregate."""
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is None or not row[c] > least_std]
