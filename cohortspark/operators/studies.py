"""Whole studies: feature sets evaluated side by side, recipes compared, collinearity, the final refit."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cohortspark.operators import aggregate, controls, crossval, metrics, reports
from cohortspark.operators.logistic import Recipe, fit_large
from cohortspark.sources import artifact

#: Figures of an earlier probe that new results are set against.
PROBE = {"balanced_accuracy": 0.682, "auc": 0.756}
RESULT = "name string, n long, n_positive long, balanced_accuracy double, lower double, upper double, sensitivity double, specificity double, f1 double, auc double, above_chance boolean"


def subject_report(scored: DataFrame, name: str, n_boot: int = 2000) -> tuple:
    """One result row of out-of-fold scores (columns subject_id, label, y_score): metrics over subjects, with interval."""
    per = aggregate.aggregate_predictions(scored.drop("y_pred")).withColumnsRenamed({"label": "y_true"})
    per = per.select("subject_id", "y_true", "y_score", "y_pred").persist()
    r, ci, area = metrics.classification_report(per).first(), metrics.bootstrap_ci(per, n_boot=n_boot).first(), metrics.auc(per).first().auc
    per.unpersist()
    return (name, r.n, r.n_positive, r.balanced_accuracy, ci.lower, ci.upper, r.sensitivity, r.specificity, r.f1, area, bool(ci.lower is not None and ci.lower > 0.5))


def evaluate_sets(df: DataFrame, sets: dict[str, list[str]], control: str | None = None, recipe: Recipe | None = None, n_boot: int = 2000) -> DataFrame:
    """One row per feature set, cross-validated over the frame's folds; with `control` also that set under shuffled labels.

    Labels are shuffled among the subjects of each fold, so the control isn't biased below chance.
    """
    rows = [subject_report(crossval.cross_validate(df, features, recipe), name, n_boot) for name, features in sets.items()]
    if control is not None:
        shuffled = controls.shuffle_by_subject(df, within="fold")
        rows.append(subject_report(crossval.cross_validate(shuffled, sets[control], recipe), f"{control} (shuffled)", n_boot))
    return df.sparkSession.createDataFrame(rows, RESULT)


def compare_recipes(df: DataFrame, features: dict[str, list[str]], grids: dict[str, list[Recipe]], n_boot: int = 2000) -> DataFrame:
    """One row per name of `features`, by nested cross-validation over its grid; best balanced accuracy first.

    Recipes that ask for more columns than a set has are left out; if none is left, all columns at c = 0.1.
    """
    rows = []
    for name, columns in features.items():
        grid = [r for r in grids[name] if r.k is None or r.k <= len(columns)] or [Recipe(c=0.1, k=len(columns))]
        predictions, _ = crossval.nested_cross_validate(df, columns, grid)
        rows.append(subject_report(predictions.drop("n_rows"), name, n_boot))
    return reports.rank_by(df.sparkSession.createDataFrame(rows, RESULT), "balanced_accuracy", ties=["name"])


def against_probe(results: DataFrame, probe: dict[str, float] | None = None) -> DataFrame:
    """`results` with the difference of each figure from the probe's."""
    return results.withColumns({f"{k}_delta": F.col(k) - F.lit(v) for k, v in (probe or PROBE).items()})


def collinearity(df: DataFrame, features: list[str], c: float = 1.0) -> DataFrame:
    """One row per feature: coefficient of a fit on everything, and the feature it correlates with most."""
    model = fit_large(df, features, c=c)
    pairs = [(r.feature_a, r.feature_b, r.abs_r) for r in reports.correlations(df, features).collect()]  # features² / 2 rows
    rows = []
    for name, w in zip(features, model["coefficients"]):
        others = [(r if r is not None else -1.0, b if a == name else a) for a, b, r in pairs if name in (a, b)]
        top = max(others, default=(None, None))
        rows.append((name, float(w), top[1], top[0]))
    return reports.rank_by(df.sparkSession.createDataFrame(rows, "feature string, coefficient double, nearest string, abs_r double"), "coefficient", absolute=True)


def final_refit(df: DataFrame, features: list[str], grid: list[Recipe], name: str = "final") -> tuple[dict, Row]:
    """The model of the most often chosen strength, fitted on everything; the stored metrics are those of nested validation."""
    predictions, chosen = crossval.nested_cross_validate(df, features, grid)
    best = crossval.selection_stability(chosen, ["grid"]).first()["grid"]
    row = subject_report(predictions.drop("n_rows"), name)
    stored = dict(zip((c.split()[0] for c in RESULT.split(", ")), row))
    model = fit_large(df, features, c=grid[best].c)
    scores = {k: v for k, v in stored.items() if isinstance(v, float)}
    settings = {k: str(v) for k, v in asdict(grid[best]).items()}
    return model, artifact.card(df.sparkSession, name, features, source="frame", target="demented", subjects=stored["n"], scores=scores, settings=settings)
