"""Reports over cohorts: counts, moments, correlations, availability, severity."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, columns: list[str], dropna: bool = True, share: bool = False) -> DataFrame:
    """Rows per combination of values, most frequent first, then by value; with `share` also their part of all counted."""
    if dropna:
        for c in columns:
            df = df.where(F.col(c).isNotNull())
    counted = df.groupBy(*columns).agg(F.count("*").alias("count"))
    if share:
        counted = counted.withColumn("share", F.bround(F.col("count") / F.lit(max(1, df.count())), 2))
    return counted.orderBy(F.col("count").desc(), *columns)


def group_means(df: DataFrame, group: str, features: list[str], digits: int = 4) -> DataFrame:
    return df.groupBy(group).agg(*[F.bround(F.avg(f), digits).alias(f) for f in features])


def describe(df: DataFrame, features: list[str]) -> DataFrame:
    """One row per feature: mean, std (sample), min and max of its present values."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]))
    long = df.select(cells.alias("c")).select("c.feature", "c.v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    return long.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("n"))


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """One row per pair of features: r (Pearson, over rows where both are present) and abs_r, strongest first."""
    clean = df.select(*[F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f) for f in features])
    pairs = list(combinations(features, 2))
    row = clean.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(cells)).withColumn("abs_r", F.abs("r")).orderBy(F.col("abs_r").desc(), "feature_a", "feature_b")


def group_deltas(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Per feature: its mean among controls and cases, and the difference."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]))
    long = df.select(label, cells.alias("c")).select(label, "c.feature", "c.v").where(~F.isnan("v"))
    per = long.groupBy("feature").agg(F.avg(F.when(F.col(label) == 0, F.col("v"))).alias("mean_cn"), F.avg(F.when(F.col(label) == 1, F.col("v"))).alias("mean_demented"))
    return per.withColumn("delta", F.col("mean_demented") - F.col("mean_cn"))


SEVERITY_NAMES = {0.5: "very mild", 1.0: "mild", 2.0: "moderate"}


def named(column: Column, names: dict, default: str = "?") -> Column:
    out = None
    for k, v in names.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(default)


def severity_sensitivity(predictions: DataFrame) -> DataFrame:
    """Of the positives, per rating: n, detected, sensitivity to three decimals, name, share of all positives."""
    per = predictions.where(F.col("label") == 1).groupBy("cdr").agg(F.count("*").alias("n"), F.sum("y_pred").alias("detected"), F.bround(F.avg("y_pred"), 3).alias("sensitivity"))
    return per.withColumns({"severity": named(F.col("cdr"), SEVERITY_NAMES), "share": F.col("n") / F.sum("n").over(Window.partitionBy())}).orderBy("cdr")


def mean_by_subset(df: DataFrame, flag: str, value: str) -> DataFrame:
    """One row: the mean of `value` where the flag holds and where it doesn't."""
    return df.agg(F.avg(F.when(F.col(flag), F.col(value))).alias("mean_present"), F.avg(F.when(~F.col(flag), F.col(value))).alias("mean_missing"))


def availability_by(df: DataFrame, group: str) -> DataFrame:
    """Per group: rows, cases, controls, and how many have an image."""
    per = df.groupBy(group).agg(F.count("*").alias("n"), F.sum("label").alias("n_demented"), F.count_if("image_available").alias("n_available"))
    return per.withColumn("n_cn", F.col("n") - F.col("n_demented"))


def image_states_by(df: DataFrame, group: str) -> DataFrame:
    """Per group: rows, cases, controls, and how many have one image, several, and none."""
    several = F.col("image_ambiguous")
    per = df.groupBy(group).agg(F.count("*").alias("n"), F.sum("label").alias("n_demented"), F.count_if(F.col("image_available") & ~several).alias("n_one"), F.count_if(several).alias("n_ambiguous"), F.count_if(~F.col("image_available")).alias("n_none"))
    return per.withColumn("n_cn", F.col("n") - F.col("n_demented"))


def exclusions(conflicted: DataFrame) -> DataFrame:
    """Subjects and slices by conflict, of subjects with nl labels, nf folds and n_slices."""
    conflicts = (F.col("nl") > 1).alias("label_conflict"), (F.col("nf") > 1).alias("fold_conflict")
    return conflicted.groupBy(*conflicts).agg(F.count("*").alias("n_subjects"), F.sum("n_slices").alias("n_slices"))


def argmax_first(trace: DataFrame, group: list[str], score: str, index: str) -> DataFrame:
    """Per group the row with the highest score; of equals the one with the smallest index."""
    rest = [c for c in trace.columns if c not in group]
    best = F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(index)))
    return trace.groupBy(*group).agg(best.alias("b")).select(*group, "b.*")


def rank_by(df: DataFrame, column: str, absolute: bool = False, ties: list[str] | None = None) -> DataFrame:
    key = F.abs(column) if absolute else F.col(column)
    return df.orderBy(key.desc_nulls_last(), *(ties or [c for c in df.columns if c != column]))
