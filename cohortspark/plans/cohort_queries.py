"""Registered queries over sessions, folds, slice predictions, images: the tables' subjects and sessions made canonical first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.ids import session_key, subject_key
from cohortspark.operators import aggregate, folds, joins, manifest, metrics, reports
from cohortspark.plans.shared import written
from cohortspark.sources import images
from cohortspark.sources.tables import table

N_SPLITS, SEED = 5, 42


def raw_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """subject_records in the columns of a metadata sheet; rows of unknown subject or session have no id."""
    c = F.col
    return table(spark, sf, "subject_records").select(
        "record_id", F.concat(subject_key(c("subject_id"), c("raw_id")), F.lit("_"), session_key(c("session_id"), c("raw_id"))).alias("ID"),
        c("sex").alias("M/F"), c("age").alias("Age"), c("education").alias("Educ"), c("ses").alias("SES"), c("mmse").alias("MMSE"),
        c("cdr").alias("CDR"), c("etiv").alias("eTIV"), c("nwbv").alias("nWBV"), c("asf").alias("ASF"), "site",
    )


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.add_control_eligibility(manifest.build_manifest(raw_sheet(spark, sf)))


def manifest_build(spark: SparkSession, sf: str) -> DataFrame:
    return sessions(spark, sf)


def manifest_violations(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.violations(sessions(spark, sf))


def cohort_filter(spark: SparkSession, sf: str) -> DataFrame:
    return sessions(spark, sf).where("age_matched_cohort").groupBy("label", "sex").agg(F.count("*").alias("n"), F.count_distinct("subject_id").alias("n_subjects"))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return _by_subject(sessions(spark, sf).where("age_matched_cohort"))


def _by_subject(cohort: DataFrame) -> DataFrame:
    """Cohort subjects: the highest label of a subject is its label, its age that of its last year."""
    return cohort.groupBy("subject_id").agg(F.max("label").alias("label"), F.max("age").alias("age"), F.max("cdr").alias("cdr"))


def fold_assign(spark: SparkSession, sf: str) -> DataFrame:
    return folds.assign_subject_folds(_labelled(spark, sf), N_SPLITS, SEED)


def fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: manifest, cohort, folds, attachment to all sessions, summary."""
    cohort = written(sessions(spark, sf).where("age_matched_cohort").select("subject_id", "label", "age", "cdr"), "cohort")
    labels = _by_subject(cohort)
    rows = cohort.select("subject_id", "age").join(labels.select("subject_id", "label"), "subject_id")
    return folds.summarize_folds(folds.attach_folds(rows, folds.assign_subject_folds(labels, N_SPLITS, SEED)))


def fold_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and cases on either side of each fold."""
    assigned = fold_assign(spark, sf)
    sides = [(k, part, rows) for k in range(N_SPLITS) for part, rows in zip(("train", "test"), folds.train_test(assigned, k))]
    per = [rows.agg(F.count("*").alias("n"), F.sum("label").alias("n_demented")).select(F.lit(k).alias("fold"), F.lit(part).alias("side"), "n", "n_demented") for k, part, rows in sides]
    return reduce(DataFrame.unionByName, per)


def label_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return folds.conflicts(sessions(spark, sf), "subject_id", "label")


def _slices(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "slice_scores").select(
        subject_key(F.col("subject_id")).alias("subject_id"), "label", "fold", "slice_position", "y_score"
    ).where(F.col("subject_id").isNotNull()).distinct()


def slice_leakage(spark: SparkSession, sf: str) -> DataFrame:
    return folds.conflicts(_slices(spark, sf), "subject_id", "fold")


def _conflicted(rows: DataFrame) -> DataFrame:
    """Subjects of slices with several labels (nl) or folds (nf), with their number of slices."""
    return rows.groupBy("subject_id").agg(F.count_distinct("label").alias("nl"), F.count_distinct("fold").alias("nf"), F.count("*").alias("n_slices")).where("nl > 1 or nf > 1")


def _clean_slices(spark: SparkSession, sf: str) -> DataFrame:
    rows = _slices(spark, sf)
    return written(joins.absent(rows, _conflicted(rows), "subject_id"), "clean-slices")  # guards and folds read it again


def slice_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    """What the queries over slices leave out: subjects, and their slices, by whether labels or folds conflict."""
    return reports.exclusions(_conflicted(_slices(spark, sf)))


def _aggregated(method: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        per = aggregate.aggregate_predictions(_clean_slices(spark, sf), method)
        return per.withColumn("y_score", F.round("y_score", 9)).where(F.col("n_slices") > 0)

    return query


def agreement(spark: SparkSession, sf: str) -> DataFrame:
    per = aggregate.slice_agreement(_clean_slices(spark, sf))
    return per.withColumns({"agreement": F.round("agreement", 6), "score_std": F.round("score_std", 6)})


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    per = _aggregated("max")(spark, sf)
    return written(per.select("subject_id", F.col("label").alias("y_true"), "y_pred", "y_score"), "predictions")


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(_predictions(spark, sf))


def report(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.classification_report(_predictions(spark, sf))
    return found.select([F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


def auc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.auc(_predictions(spark, sf)).select(F.round("auc", 9).alias("auc"))


def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    points = metrics.roc_points(_predictions(spark, sf))
    return points.select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


def _interval(found: DataFrame) -> DataFrame:
    return found.select(*[F.round(c, 9).alias(c) for c in ("point", "lower", "upper")], "n_eff")


def bootstrap_ba(spark: SparkSession, sf: str) -> DataFrame:
    found = _interval(metrics.bootstrap_ci(_predictions(spark, sf)))
    return found.withColumns({"text": metrics.format_ci(F.col("point"), F.col("lower"), F.col("upper")), "beats_chance": metrics.beats_chance(F.col("lower"))})


def bootstrap_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _interval(metrics.bootstrap_ci(_predictions(spark, sf), "auc"))


def _two_models(spark: SparkSession, sf: str) -> DataFrame:
    """Mean beside maximum of the slices."""
    slices = _clean_slices(spark, sf)
    mean, high = (aggregate.aggregate_predictions(slices, m).where("n_slices > 0") for m in ("mean", "max"))
    both = joins.suffix_join(mean.select("subject_id", "y_pred", "y_score"), high.select("subject_id", "y_pred", "y_score", F.col("label").alias("y_true")), ["subject_id"], ("_mean", "_max"))
    return written(both.withColumns({f"y_score_{m}": F.round(f"y_score_{m}", 9) for m in ("mean", "max")}), "two-models")


def bootstrap_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _interval(metrics.bootstrap_difference(_two_models(spark, sf), "y_pred_mean", "y_pred_max"))


def bootstrap_auc_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _interval(metrics.bootstrap_difference(_two_models(spark, sf), "y_score_mean", "y_score_max", "auc"))


def _images(spark: SparkSession, sf: str) -> DataFrame:
    return images.find_images(table(spark, sf, "session_files"))


def ambiguous_images(spark: SparkSession, sf: str) -> DataFrame:
    return _images(spark, sf).where("n_images > 1")


def _attached(spark: SparkSession, sf: str) -> DataFrame:
    return images.attach_images(sessions(spark, sf).select("subject_id", "raw_id", "label", "age", "sex", "cdr", "nwbv", "etiv", "asf", "mmse", "education").distinct(), _images(spark, sf))


def _available(spark: SparkSession, sf: str) -> DataFrame:
    """As the SQL counts: a session of several images isn't available. image_states and its reports tell it from one without."""
    return _attached(spark, sf).withColumn("image_available", F.col("image_available") & ~F.col("image_ambiguous")).drop("image_ambiguous")


def _by_fold(report, rows: DataFrame, assigned: DataFrame, counts: list[str]) -> DataFrame:
    per = report(rows.drop("label").join(assigned, "subject_id"), "fold")
    every = rows.sparkSession.range(N_SPLITS).select(F.col("id").cast("int").alias("fold"))
    return joins.completed(per, every, "fold", counts)


def availability(spark: SparkSession, sf: str) -> DataFrame:
    return _available(spark, sf).select("raw_id", "label", "age", "image_path", "image_available").distinct()


def availability_by_fold(spark: SparkSession, sf: str) -> DataFrame:
    return _by_fold(reports.availability_by, _available(spark, sf), fold_assign(spark, sf), ["n", "n_demented", "n_available", "n_cn"])


def missing_vs_present(spark: SparkSession, sf: str) -> DataFrame:
    found = reports.mean_by_subset(_available(spark, sf), "image_available", "age")
    return found.select([F.round(c, 6).alias(c) for c in found.columns])


def image_states(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with whether they have images, and more than one."""
    return _attached(spark, sf).select("raw_id", "label", "age", "image_path", "image_available", "image_ambiguous").distinct()


def image_states_by_fold(spark: SparkSession, sf: str) -> DataFrame:
    return _by_fold(reports.image_states_by, _attached(spark, sf), fold_assign(spark, sf), ["n", "n_demented", "n_one", "n_ambiguous", "n_none", "n_cn"])


def image_state_ages(spark: SparkSession, sf: str) -> DataFrame:
    """Mean age of the sessions with one image, several, and none."""
    state = F.when(F.col("image_ambiguous"), "ambiguous").when(F.col("image_available"), "one").otherwise("none")
    return _attached(spark, sf).groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.round(F.avg("age"), 6).alias("mean_age"))


def files_without_record(spark: SparkSession, sf: str) -> DataFrame:
    return joins.absent(_images(spark, sf), sessions(spark, sf), "raw_id").select("raw_id")


FEATURES = ["age", "education", "mmse", "etiv", "asf"]


def group_means(spark: SparkSession, sf: str) -> DataFrame:
    found = reports.group_means(sessions(spark, sf), "label", ["age", "etiv", "asf"], 4)
    return found.select("label", *[F.round(c, 3).alias(c) for c in ("age", "etiv", "asf")])


def describe(spark: SparkSession, sf: str) -> DataFrame:
    found = reports.describe(sessions(spark, sf), FEATURES)
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


def correlations(spark: SparkSession, sf: str) -> DataFrame:
    found = reports.correlations(sessions(spark, sf), FEATURES)
    return found.select("feature_a", "feature_b", F.round("r", 6).alias("r"))


def group_deltas(spark: SparkSession, sf: str) -> DataFrame:
    found = reports.group_deltas(sessions(spark, sf), FEATURES)
    return found.select("feature", *[F.round(c, 6).alias(c) for c in ("mean_cn", "mean_demented", "delta")])


def severity_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    ratings = sessions(spark, sf).groupBy("subject_id").agg(F.max("cdr").alias("cdr"))
    scored = joins.one_to_one_join(_aggregated("max")(spark, sf).select("subject_id", "label", "y_pred"), ratings, ["subject_id"])
    return reports.severity_sensitivity(scored).select("cdr", "n", "detected", F.round("sensitivity", 3).alias("sensitivity"), "severity", F.round("share", 6).alias("share"))


def site_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.value_counts(table(spark, sf, "subject_records").select("site", "sex"), ["site", "sex"])


def suffix_join(spark: SparkSession, sf: str) -> DataFrame:
    """First and last aggregation of the same subjects beside each other."""
    low, high = (_aggregated(m)(spark, sf).select("subject_id", "label", "y_score") for m in ("mean", "max"))
    return joins.suffix_join(low, high, ["subject_id"], ("_mean", "_max"))


def lookup_join(spark: SparkSession, sf: str) -> DataFrame:
    """Sites of the records' sheets; null for those without a sheet."""
    sheets = table(spark, sf, "sheets").groupBy("site").agg(F.min("sheet_id").alias("sheet_id"))
    return joins.lookup(table(spark, sf, "subject_records").select("record_id", "site"), sheets, "site", "sheet_id", "first_sheet")


def shuffle_within_fold(spark: SparkSession, sf: str) -> DataFrame:
    from cohortspark.operators.controls import shuffle_labels

    return shuffle_labels(fold_assign(spark, sf), "subject_id", "label", SEED, within="fold")


def shuffle_global(spark: SparkSession, sf: str) -> DataFrame:
    from cohortspark.operators.controls import shuffle_labels

    return shuffle_labels(fold_assign(spark, sf), "subject_id", "label", SEED)


def shuffle_subject(spark: SparkSession, sf: str) -> DataFrame:
    """Slices with labels dealt anew among subjects."""
    from cohortspark.operators.controls import shuffle_by_subject

    return shuffle_by_subject(_clean_slices(spark, sf), "label", SEED)


def ranked_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Sites by mean age of their records, best first, with the number of distinct subjects and batches."""
    records = table(spark, sf, "subject_records").withColumn("who", subject_key(F.col("subject_id"), F.col("raw_id")))
    per = records.groupBy("site").agg(F.round(F.avg("age"), 6).alias("mean_age"), F.count_distinct("who").alias("n_subjects"), F.count_distinct("batch_day").alias("n_days"))
    return reports.rank_by(per, "mean_age", ties=["site"])


def top_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The ten first sessions by name that have images."""
    return _images(spark, sf).select("raw_id").orderBy("raw_id").limit(10)


def label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct subjects and labels of sessions and slices together."""
    pairs = sessions(spark, sf).select("subject_id", "label").unionByName(_slices(spark, sf).select("subject_id", "label"))
    return pairs.distinct()


def slice_subjects_without_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _slices(spark, sf).select("subject_id").subtract(sessions(spark, sf).select("subject_id"))


def aligned_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Two models' predictions of the same subjects, by subject: how often they agree, per label."""
    mean = _aggregated("mean")(spark, sf).select("subject_id", F.col("y_pred").alias("other"))
    both = joins.one_to_one_join(_predictions(spark, sf), mean, ["subject_id"])
    return both.groupBy("y_true").agg(F.count("*").alias("n"), F.count_if(F.col("y_pred") == F.col("other")).alias("n_agree"))


QUERIES = {
    "ranked_sites": ranked_sites, "top_sessions": top_sessions, "label_pairs": label_pairs, "slice_subjects_without_sessions": slice_subjects_without_sessions,
    "aligned_predictions": aligned_predictions,
    "fold_summary": fold_summary, "manifest_build": manifest_build, "manifest_violations": manifest_violations, "cohort_filter": cohort_filter,
    "fold_assign": fold_assign, "label_conflicts": label_conflicts, "slice_leakage": slice_leakage, "slice_exclusions": slice_exclusions,
    "agg_mean": _aggregated("mean"), "agg_median": _aggregated("median"), "agg_max": _aggregated("max"), "slice_agreement": agreement,
    "confusion": confusion, "report": report, "auc": auc, "roc_points": roc_points, "bootstrap_ba": bootstrap_ba, "bootstrap_diff": bootstrap_diff, "bootstrap_auc": bootstrap_auc, "bootstrap_auc_diff": bootstrap_auc_diff, "fold_masks": fold_masks,
    "ambiguous_images": ambiguous_images, "availability": availability, "availability_by_fold": availability_by_fold,
    "missing_vs_present": missing_vs_present, "files_without_record": files_without_record,
    "image_states": image_states, "image_states_by_fold": image_states_by_fold, "image_state_ages": image_state_ages,
    "group_means": group_means, "describe": describe, "correlations": correlations, "group_deltas": group_deltas,
    "severity_sensitivity": severity_sensitivity, "site_counts": site_counts, "suffix_join": suffix_join, "lookup_join": lookup_join,
    "shuffle_global": shuffle_global, "shuffle_within_fold": shuffle_within_fold, "shuffle_subject": shuffle_subject,
}
