"""Volumes in pairs of header and image files: a header of 348 bytes, and voxels with the first axis fastest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.plans.shared import ship

#: Fixed values of the format: size of the header, and number types by code.
HEADER_SIZE = 348
NUMBER_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8"}
VOLUME = T.StructType([T.StructField("path", T.StringType()), T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(T.FloatType()))])


def decode(header: bytes, image: bytes) -> tuple[list[int], np.ndarray]:
    """(shape, voxels in C order); ValueError for other headers and for volumes that aren't three-dimensional."""
    order = next((o for o in "<>" if len(header) >= HEADER_SIZE and np.frombuffer(header, f"{o}i4", 1)[0] == HEADER_SIZE), None)
    if order is None:
        raise ValueError("not a volume header")
    sizes = np.frombuffer(header, f"{order}i2", 8, 40)
    shape = [int(s) for s in sizes[1 : 1 + sizes[0]]]
    while len(shape) > 3 and shape[-1] == 1:
        shape.pop()
    if len(shape) != 3:
        raise ValueError(f"expected 3 dimensions, got {len(shape)}")
    code = int(np.frombuffer(header, f"{order}i2", 1, 70)[0])
    if code not in NUMBER_TYPES:
        raise ValueError(f"unknown number type {code}")
    voxels = np.frombuffer(image, order + NUMBER_TYPES[code], int(np.prod(shape)))
    return shape, voxels.reshape(shape, order="F").ravel(order="C").astype(np.float32)


def encode(shape: list[int], data: np.ndarray) -> tuple[bytes, bytes]:
    """Header and image of a volume of floats."""
    header = bytearray(HEADER_SIZE)
    header[0:4] = np.array([HEADER_SIZE], "<i4").tobytes()
    header[40:56] = np.array([len(shape), *shape, *[1] * (7 - len(shape))], "<i2").tobytes()
    header[70:74] = np.array([16, 32], "<i2").tobytes()
    return bytes(header), np.asarray(data, "<f4").reshape(shape).ravel(order="F").tobytes()


def read_volumes(spark: SparkSession, root: str) -> DataFrame:
    """(path, shape, data) of every pair `*.hdr`, `*.img` below `root`; a header without image is left out."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    stem = F.regexp_extract("path", r"^(.*)\.(hdr|img)$", 1)
    parts = files.select(stem.alias("stem"), F.regexp_extract("path", r"\.(hdr|img)$", 1).alias("kind"), "content").where("kind <> ''")
    pairs = parts.where("kind = 'hdr'").select("stem", F.col("content").alias("header")).join(parts.where("kind = 'img'").select("stem", F.col("content").alias("image")), "stem")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [decode(h, i) for h, i in zip(batch["header"], batch["image"])]
            yield pd.DataFrame({"path": [re.sub("^file:", "", s) + ".img" for s in batch["stem"]], "shape": [s for s, _ in found], "data": [d for _, d in found]})

    return pairs.mapInPandas(run, VOLUME)


def read_segmentations(spark: SparkSession, root: str) -> DataFrame:
    """As read_volumes, with labels as whole numbers; fractions are cut off, towards 0."""
    return read_volumes(spark, root).withColumn("data", F.col("data").cast("array<smallint>"))


def cached(spark: SparkSession, path: str, make, rebuild: bool = False) -> DataFrame:
    """The Parquet table at `path`; made by `make()` and written there if it isn't, or if `rebuild`. Put every parameter in the path."""
    if not rebuild:
        try:
            return spark.read.parquet(path)
        except Exception:  # noqa: S110 - not there yet
            pass
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
