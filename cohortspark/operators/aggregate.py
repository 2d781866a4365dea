"""From slices back to subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.folds import _refuse, conflicts
from cohortspark.operators.manifest import require_columns

REDUCERS = {"mean": F.avg, "median": F.median, "max": F.max}


def aggregate_predictions(slices: DataFrame, method: str = "mean", threshold: float = 0.5, score: str = "y_score", label: str = "label") -> DataFrame:
    """One row per subject: y_score (mean, median or max of its slices), y_pred, n_slices, label, and fold and age if given.

    Null and not-a-number scores are left out; a subject without any has none and y_pred null. ValueError for an unknown
    method, a threshold outside (0, 1), missing columns, and subjects with two labels or folds. age is the smallest.
    """
    if method not in REDUCERS:
        raise ValueError(f"method must be one of {sorted(REDUCERS)}")
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    require_columns(slices, ["subject_id", label, score])
    for c in (label, "fold"):
        if c in slices.columns:
            _refuse(conflicts(slices, "subject_id", c), "subject_id", f"more than one {c}")
    value = F.when(~F.isnan(score), F.col(score))
    extra = [F.min(c).alias(c) for c in ("fold", "age") if c in slices.columns]
    per = slices.groupBy("subject_id").agg(F.min(label).alias("label"), REDUCERS[method](value).alias("y_score"), F.count(value).alias("n_slices"), *extra)
    return per.withColumn("y_pred", (F.col("y_score") >= threshold).cast("int"))


def slice_agreement(slices: DataFrame, threshold: float = 0.5, score: str = "y_score") -> DataFrame:
    """Per subject: n_slices, the majority vote (a tie is 0), the share of slices that agree, population std of scores."""
    value = F.when(~F.isnan(score), F.col(score))
    per = slices.where(value.isNotNull()).groupBy("subject_id").agg(F.count("*").alias("n_slices"), F.count_if(value >= threshold).alias("n_positive"), F.stddev_pop(value).alias("score_std"))
    majority = F.when(2 * F.col("n_positive") > F.col("n_slices"), 1).otherwise(0)
    agree = F.when(majority == 1, F.col("n_positive")).otherwise(F.col("n_slices") - F.col("n_positive"))
    return per.select("subject_id", "n_slices", "n_positive", majority.alias("majority"), (agree / F.col("n_slices")).alias("agreement"), "score_std")
