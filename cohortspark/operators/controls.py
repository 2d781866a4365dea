"""Negative controls: labels dealt anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.draws import digest
from cohortspark.operators.folds import position_in_group
from cohortspark.operators.joins import many_to_one_join


def shuffle_labels(df: DataFrame, key: str, label: str = "label", seed: int = 0, within: str | None = None) -> DataFrame:
    """`df` with its labels permuted among its rows, or within each group of `within`; the counts of labels stay.

    `key` must tell the rows apart. Row i in the order of one digest of the key gets the label of row i in the order of
    another, so the result depends on the seed alone, not on partitions. Both orders are numbered bucket by bucket.
    """
    group = "_all" if within is None else within
    rows = df.withColumn("_all", F.lit(0)) if within is None else df
    receive = position_in_group(rows.drop(label), group, digest(f"{seed}a", F.col(key)), "_n")
    give = position_in_group(rows.select(group, F.col(key).alias("_key"), F.col(label).alias("_label")), group, digest(f"{seed}b", F.col("_key")), "_n")
    return receive.join(give.drop("_key"), [group, "_n"]).withColumnRenamed("_label", label).drop("_n", "_all").select(*df.columns)


def shuffle_by_subject(df: DataFrame, label: str = "label", seed: int = 0, within: str | None = None) -> DataFrame:
    """`df` with labels permuted among its subjects, or within each group of `within`; all rows of a subject get one label.

    ValueError for subjects with two labels or groups.
    """
    pairs = df.select("subject_id", label, *([] if within is None else [within])).distinct()
    dealt = shuffle_labels(pairs, "subject_id", label, seed, within).select("subject_id", label)
    return many_to_one_join(df.drop(label), dealt, ["subject_id"]).select(*df.columns)
