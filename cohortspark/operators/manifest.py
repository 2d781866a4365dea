"""Manifest of sessions from raw metadata: ids, labels, validation, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED = ("ID", "M/F", "Age", "Educ", "SES", "MMSE", "CDR", "eTIV", "nWBV", "ASF")


def require_columns(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """`df` itself; ValueError that lists the columns it lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def derive_label(cdr: Column) -> Column:
    """0 for a rating of 0, 1 from 0.5 on; null for null, not-a-number and everything else."""
    known = F.when(~F.isnan(cdr), cdr)
    return F.when(known == 0, F.lit(0)).when(known >= 0.5, F.lit(1)).cast("int")


def _checked_parts(parts: Column, raw_id: Column) -> Column:
    """Three parts of an id; raises for any other number. Null stays null."""
    return F.when(parts.isNull() | (F.size(parts) == 3), parts).otherwise(F.raise_error(F.concat(F.lit("not a session id: "), raw_id)))


def build_manifest(raw: DataFrame) -> DataFrame:
    """One typed row per labelled session of a raw metadata sheet.

    Rows without a label are dropped before their id is parsed, so that a malformed id among them is no error. Numbers
    that are missing (null or not-a-number) are null. raw_id is kept as it is, not trimmed.
    """
    require_columns(raw, REQUIRED)
    label = derive_label(F.col("CDR").cast("double"))
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    # in steps, so that no step repeats the expressions of the one before
    split = raw.select(
        F.when(label.isNotNull(), F.split(F.trim("ID"), "_")).alias("parts"), F.col("ID").alias("raw_id"), F.col("M/F").alias("sex"), F.col("Age").cast("int").alias("age"),
        number("Educ").alias("education"), number("SES").alias("ses"), number("MMSE").alias("mmse"), F.col("CDR").cast("double").alias("cdr"),
        label.alias("label"), F.col("eTIV").cast("int").alias("etiv"), number("nWBV").alias("nwbv"), number("ASF").alias("asf"),
    ).where(F.col("label").isNotNull())
    rest = split.columns[1:]
    checked = split.select(_checked_parts(F.col("parts"), F.col("raw_id")).alias("parts"), *rest)
    subject = F.when(F.col("parts").isNotNull(), F.concat_ws("_", F.get("parts", F.lit(0)), F.get("parts", F.lit(1))))
    return checked.select(subject.alias("subject_id"), F.get("parts", F.lit(2)).alias("session_id"), *rest)


def add_control_eligibility(manifest: DataFrame, min_control_age: int = 60) -> DataFrame:
    """age_matched_cohort: every case, and controls from `min_control_age` on."""
    return manifest.withColumn("age_matched_cohort", F.coalesce((F.col("label") == 1) | ((F.col("label") == 0) & (F.col("age") >= min_control_age)), F.lit(False)))


def violations(manifest: DataFrame) -> DataFrame:
    """One row: how many rows lack each field that a manifest must have, or have a label other than 0 and 1."""
    must = ("subject_id", "session_id", "raw_id", "sex", "age", "cdr", "label", "etiv", "nwbv", "asf")
    missing = {c: F.col(c).isNull() | (F.isnan(c) if c in ("cdr", "nwbv", "asf") else F.lit(False)) for c in must}
    return manifest.agg(F.count("*").alias("n"), *[F.count_if(m).alias(f"{c}_missing") for c, m in missing.items()], F.count_if(~F.col("label").isin(0, 1)).alias("label_invalid"))
