"""Image files of sessions: name patterns, lookup, availability."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder below the session's and what follows the session's name there, by variant; `*` is the number of scans.
VARIANTS = {
    "t88_masked_gfc": ("PROCESSED/MPRAGE/T88_111", "_mpr_n*_anon_111_t88_masked_gfc"),
    "t88_gfc": ("PROCESSED/MPRAGE/T88_111", "_mpr_n*_anon_111_t88_gfc"),
    "subject_native": ("PROCESSED/MPRAGE/SUBJ_111", "_mpr_n*_anon_sbj_111"),
    "fsl_seg": ("FSL_SEG", "_mpr_n*_anon_111_t88_masked_gfc_fseg"),
}
DEFAULT_VARIANT = "t88_masked_gfc"


def image_pattern(variant: str = DEFAULT_VARIANT, suffix: str = "img") -> str:
    """Regular expression of an image's path: folder of the disc, of the session, and the file; group 1 is the session."""
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {sorted(VARIANTS)}")
    folder, name = VARIANTS[variant]
    tail = "[^/]*".join(re.escape(part) for part in name.split("*"))
    return rf"(?:^|/)disc[^/]*/(OAS1_[^/]+)/{folder}/\1{tail}\.{suffix}$"


def session_of(path: Column, variant: str = DEFAULT_VARIANT, suffix: str = "img") -> Column:
    """Session that an image path belongs to; null where it is no image of the variant or lies in a wrong folder."""
    found = F.regexp_extract(path, image_pattern(variant, suffix), 1)
    return F.when(found != "", found)


def find_images(listing: DataFrame, variant: str = DEFAULT_VARIANT) -> DataFrame:
    """(raw_id, n_images, image_path) of a listing with image_path and size_bytes. Empty files and repeated rows don't count."""
    named = listing.where(F.col("size_bytes") > 0).select(session_of(F.col("image_path"), variant).alias("raw_id"), "image_path")
    return named.where(F.col("raw_id").isNotNull()).groupBy("raw_id").agg(F.count_distinct("image_path").alias("n_images"), F.min("image_path").alias("image_path"))


def assert_unambiguous(images: DataFrame) -> DataFrame:
    twice = [r["raw_id"] for r in images.where("n_images > 1").orderBy("raw_id").limit(5).collect()]
    if twice:
        raise ValueError(f"Ambiguous images of sessions {twice}")
    return images


def attach_images(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """`manifest` with image_path ('' where there isn't just one), image_available and image_ambiguous, by raw_id as it is written.

    A session with several images has some, so it is available, and ambiguous.
    """
    joined = manifest.join(images.select("raw_id", "n_images", "image_path"), "raw_id", "left")
    n = F.coalesce("n_images", F.lit(0))
    path = F.when(n == 1, F.col("image_path")).otherwise(F.lit(""))
    return joined.withColumns({"image_available": n >= 1, "image_ambiguous": n > 1, "image_path": path}).drop("n_images")


def list_files(spark, root: str, pattern: str = "*") -> DataFrame:
    """(image_path, size_bytes, modified_at) of the files below `root`, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(F.col("path").alias("image_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
