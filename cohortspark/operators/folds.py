"""Folds that belong to subjects, never to rows: assignment, attachment, guards, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.draws import digest
from cohortspark.operators.joins import assert_unique, many_to_one_join
from cohortspark.plans.shared import checked_broadcast, written


def conflicts(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, n_values): keys with more than one value of `column`; null keys and values don't count."""
    seen = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(column).alias("n_values"))
    return seen.where("n_values > 1")


def _refuse(found: DataFrame, key: str, what: str) -> None:
    examples = [r[key] for r in found.orderBy(key).limit(6).collect()]
    if examples:
        total = len(examples) if len(examples) < 6 else found.count()
        raise ValueError(f"{what}: {total} subject(s), e.g. {examples[:5]}")


def assert_no_subject_leakage(df: DataFrame, subject: str = "subject_id", fold: str = "fold") -> DataFrame:
    """`df` itself; KeyError without a fold column, ValueError with the number of subjects that are in several folds."""
    for c in (subject, fold):
        if c not in df.columns:
            raise KeyError(c)
    _refuse(conflicts(df, subject, fold), subject, "leakage detected")
    return df


def position_in_group(df: DataFrame, group: str, order: Column, name: str, buckets: int = 256) -> DataFrame:
    """`df` with the row's position (from 0) in its group, by `order`, a hex digest (at least two digits).

    The digest's head buckets the rows; a window numbers each bucket and the buckets' sizes give the offsets. So a group
    of any size is numbered by many tasks, in the same order as one window over it would.
    """
    with_order = df.withColumn("_order", order).withColumn("_bucket", F.pmod(F.conv(F.substring("_order", 1, 2), 16, 10).cast("int"), F.lit(buckets)))
    sizes = with_order.groupBy(group, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = checked_broadcast(sizes.select(F.col(group).alias("_group"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")))
    own = Window.partitionBy(group, "_bucket").orderBy("_order", *[c for c in df.columns if c != group])
    joined = with_order.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(name, (F.row_number().over(own) - 1 + F.col("_offset")).cast("bigint")).drop("_order", "_bucket", "_group", "_b", "_offset")


def assign_subject_folds(manifest: DataFrame, n_splits: int = 5, seed: int = 42) -> DataFrame:
    """(subject_id, label, fold): each subject in one of `n_splits` folds, with class and total sizes alike to within 1.

    Raises ValueError for n_splits < 2, for subjects with conflicting labels, and where a class has fewer subjects than
    folds. Rows without a subject or label take no part. Within a class subjects are dealt in the order of a seeded
    digest of their id; each class goes on where the one before stopped.
    """
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    known = manifest.where(F.col("subject_id").isNotNull() & F.col("label").isNotNull())
    subjects = written(known.groupBy("subject_id").agg(F.min("label").alias("label"), F.max("label").alias("other")), "fold-subjects")
    _refuse(subjects.where("label <> other"), "subject_id", "conflicting labels")
    subjects = subjects.drop("other")
    sizes = {r["label"]: r["n"] for r in subjects.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()}
    if sizes and min(sizes.values()) < n_splits:
        raise ValueError(f"the smallest class has {min(sizes.values())} subjects, fewer than {n_splits} folds")
    numbered = position_in_group(subjects, "label", digest(seed, F.col("subject_id")), "_n")
    offset, so_far = F.lit(0), 0
    for label, n in sizes.items():
        offset = F.when(F.col("label") == label, so_far).otherwise(offset)
        so_far += n
    return written(numbered.select("subject_id", "label", F.pmod(F.col("_n") + offset, F.lit(n_splits)).cast("int").alias("fold")), "subject-folds")


def attach_folds(df: DataFrame, folds: DataFrame) -> DataFrame:
    """`df` with the fold of each row's subject; ValueError for subjects without one or with two rows in `folds`."""
    unknown = df.select("subject_id").distinct().join(folds.select("subject_id"), "subject_id", "left_anti")
    _refuse(unknown, "subject_id", "without fold")
    return many_to_one_join(df, folds.select("subject_id", "fold"), ["subject_id"])


def train_test(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Rows outside and inside a fold; ValueError where no row is in it."""
    test = df.where(F.col("fold") == fold)
    if test.isEmpty():
        raise ValueError(f"no fold {fold}")
    return df.where(F.col("fold") != fold), test


def summarize_folds(df: DataFrame) -> DataFrame:
    """Per fold: distinct subjects, rows, rows of each class, percentage of cases and mean age, both to one decimal."""
    return df.groupBy("fold").agg(
        F.count_distinct("subject_id").alias("n_subjects"), F.count("*").alias("n_rows"),
        F.count_if(F.col("label") == 0).alias("n_cn"), F.count_if(F.col("label") == 1).alias("n_demented"),
        F.bround(F.try_divide(F.lit(100.0) * F.sum("label"), F.count("*")), 1).alias("pct_demented"),
        F.bround(F.avg("age"), 1).alias("mean_age"),
    ).orderBy("fold")


__all__ = ["assert_no_subject_leakage", "assert_unique", "assign_subject_folds", "attach_folds", "conflicts", "position_in_group", "summarize_folds", "train_test"]
