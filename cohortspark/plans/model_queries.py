"""Registered queries that fit models: cross-validation over the volumes' features, segmentation, embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators import aggregate, crossval, embed, features, folds, reports, segment, studies
from cohortspark.operators.logistic import Recipe, fit_large
from cohortspark.plans.cohort_queries import N_SPLITS, SEED
from cohortspark.plans.voxel_queries import _SEG, _V, segmentations, volumes

FEATURES = ["csf_fraction", "grey_matter_fraction", "white_matter_fraction", "gm_wm_ratio"]
BACKBONE = "projection_64"
GRID = [Recipe(c=0.01), Recipe(c=1.0), Recipe(c=1.0, k=2), Recipe(c=1.0, components=2)]


def featured(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects with tissue features and folds."""
    found = features.tissue_features(segmentations(spark, sf)).select("subject_id", "label", *FEATURES)
    assigned = folds.assign_subject_folds(found, N_SPLITS, SEED)
    return folds.attach_folds(found, assigned)


def cv_logreg(spark: SparkSession, sf: str) -> DataFrame:
    return crossval.cross_validate(featured(spark, sf), FEATURES)


def nested_cv(spark: SparkSession, sf: str) -> DataFrame:
    return crossval.nested_cross_validate(featured(spark, sf), FEATURES, GRID)[0]


def nested_selections(spark: SparkSession, sf: str) -> DataFrame:
    return crossval.selection_stability(crossval.nested_cross_validate(featured(spark, sf), FEATURES, GRID)[1], ["c", "k", "components"])


def final_model(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients of the fit on everything, strongest first."""
    model = fit_large(featured(spark, sf), FEATURES)
    rows = list(zip(model["features"], model["coefficients"]))
    return spark.createDataFrame(rows, "feature string, coefficient double").orderBy(F.abs("coefficient").desc(), "feature")


def segment_dice(spark: SparkSession, sf: str) -> DataFrame:
    """The mixture's segmentation against the one by fixed limits."""
    ours = segment.segment_volumes(volumes(spark, sf))
    both = ours.select("subject_id", F.col("seg").alias("ours")).join(segmentations(spark, sf).select("subject_id", "seg"), "subject_id")
    return features.segmentation_agreement(both, "ours", "seg").drop("ours", "seg")


def embed_fanout(spark: SparkSession, sf: str) -> DataFrame:
    return embed.embed_cohort(volumes(spark, sf), ["subject_id", "label"], embed.backbone(BACKBONE), n=3, step=1)


def embed_cv(spark: SparkSession, sf: str) -> DataFrame:
    """Slices scored out of fold by all columns of their embedding and folded back to subjects."""
    wide = embed.widen(embed_fanout(spark, sf), embed.backbone(BACKBONE).dim)
    names = embed.embedding_columns(wide.columns)
    assigned = folds.assign_subject_folds(wide, N_SPLITS, SEED)
    scored = crossval.cross_validate(folds.attach_folds(wide, assigned), names, Recipe(c=0.01))
    return aggregate.aggregate_predictions(scored.drop("y_pred"))


SETS = {"fractions": FEATURES[:3], "ratio": FEATURES[3:], "all": FEATURES}


def baseline_study(spark: SparkSession, sf: str) -> DataFrame:
    """Feature sets side by side with a control, set against the earlier probe."""
    return studies.against_probe(studies.evaluate_sets(featured(spark, sf), SETS, control="all"))


def recipe_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return studies.compare_recipes(featured(spark, sf), SETS, {name: GRID for name in SETS})


def collinearity_study(spark: SparkSession, sf: str) -> DataFrame:
    return studies.collinearity(featured(spark, sf), FEATURES)


LEAST_STD = 0.125


def near_constant(spark: SparkSession, sf: str) -> DataFrame:
    """Voxels that hardly vary between volumes, by the name of their block of one."""
    names = {f"v_b{i // 16}_{i // 4 % 4}_{i % 4}": i for i in range(64)}
    wide = volumes(spark, sf).select(*[F.get("data", F.lit(i)).alias(n) for n, i in names.items()])
    found = features.near_constant(wide, list(names), LEAST_STD)
    return spark.createDataFrame([(n,) for n in found], "name string")


def feature_correlations(spark: SparkSession, sf: str) -> DataFrame:
    """How strongly the tissue features of a study correlate, in pairs."""
    found = reports.correlations(features.tissue_features(segmentations(spark, sf)), FEATURES)
    return found.select("feature_a", "feature_b", F.round("r", 6).alias("r"))


def final_refit(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients of the final model, whose strength nested validation chose, with the metrics stored beside it."""
    model, about = studies.final_refit(featured(spark, sf), FEATURES, [r for r in GRID if r.k is None and r.components is None])
    rows = [("coefficient", n, float(v)) for n, v in zip(model["features"], model["coefficients"])] + [("metric", n, float(v)) for n, v in sorted(about["scores"].items())]
    return spark.createDataFrame(rows, "kind string, name string, value double")


def collinear_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate feature sets, with and without the collinear ones, by nested validation over the grid's strengths."""
    plain = [r for r in GRID if r.k is None and r.components is None]
    sets = {"all": FEATURES} | {"without_" + f: [x for x in FEATURES if x != f] for f in ("csf_fraction", "gm_wm_ratio")}
    return studies.compare_recipes(featured(spark, sf), sets, {name: plain for name in sets})


QUERIES = {
    "baseline_study": baseline_study, "recipe_comparison": recipe_comparison, "collinearity_study": collinearity_study, "near_constant": near_constant,
    "feature_correlations": feature_correlations, "final_refit": final_refit, "collinear_candidates": collinear_candidates,
    "cv_logreg": cv_logreg, "nested_cv": nested_cv, "nested_selections": nested_selections, "final_model": final_model,
    "segment_dice": segment_dice, "embed_fanout": embed_fanout, "embed_cv": embed_cv,
}

_STDS = "(SELECT n, stddev_samp(v) AS sd FROM v GROUP BY n)"
_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
ORACLES = {
    "near_constant": _V + f" SELECT 'v_b' || (n // 16) || '_' || (n // 4 % 4) || '_' || (n % 4) AS name FROM {_STDS} WHERE sd IS NULL OR sd <= {LEAST_STD}",
    "feature_correlations": _V + _SEG + ", t AS (SELECT subject_id, count(*) FILTER (seg = 1) AS c, count(*) FILTER (seg = 2) AS g, count(*) FILTER (seg = 3) AS w FROM s GROUP BY subject_id), f AS (SELECT "
    + ", ".join(f"coalesce({part}, 0) AS {name}" for name, part in zip(FEATURES, ("c / nullif(c + g + w, 0)", "g / nullif(c + g + w, 0)", "w / nullif(c + g + w, 0)", "g / nullif(w, 0)"))) + " FROM t) "
    + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS r FROM f" for a, b in _PAIRS),
}
