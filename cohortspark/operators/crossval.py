"""Out-of-fold and nested cross-validation: all fits go through the rows together."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.fits import fit_folds
from cohortspark.operators.folds import assert_no_subject_leakage
from cohortspark.operators.logistic import Recipe
from cohortspark.operators.manifest import require_columns
from cohortspark.operators.reports import argmax_first
from cohortspark.plans.shared import written

#: Rows of any number are fitted, in one way: nothing reads this. The name stays for those who set it.
MAX_TRAINING_ROWS = float("inf")


def _guarded(df: DataFrame, features: list[str], label: str) -> tuple[DataFrame, list[int]]:
    require_columns(df, [*features, label, "subject_id", "fold"])
    assert_no_subject_leakage(df)
    x = F.array(*[F.col(f).cast("double") for f in features])
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v))
    per = df.groupBy("fold").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(F.col(label) == 1).alias("p")).orderBy("fold").collect()
    if any(r["bad"] for r in per):
        raise ValueError("features hold null or not-a-number")
    n, p = sum(r["n"] for r in per), sum(r["p"] for r in per)
    for r in per:
        if p - r["p"] in (0, n - r["n"]):
            raise ValueError(f"without fold {r['fold']} the training rows hold a single class")
    return written(df.withColumns({"_x": x, "_y": F.col(label).cast("int")}), "crossval-rows"), [r["fold"] for r in per]


def _scores(rows: DataFrame, folds: list[int], tasks: list[tuple[int, int, int]], grid: list[Recipe]) -> DataFrame:
    """`rows` with outer, inner, grid and y_score for every task that scores them: fitted outside both folds, scored inside
    the inner, or the outer if -1. Tasks that leave out the same folds share a fit."""
    keys = [(frozenset({o} if i == -1 else {o, i}), g) for o, i, g in tasks]
    fits = list(dict.fromkeys(keys))
    center, found = fit_folds(rows, folds, [(out, grid[g]) for out, g in fits])
    model = dict(zip(fits, found))
    plan = [(i if i >= 0 else o, o, i, g, model[k][0].tolist(), model[k][1]) for (o, i, g), k in zip(tasks, keys)]
    plan = F.broadcast(rows.sparkSession.createDataFrame(plan, "_tested int, _outer int, _inner int, _grid int, _w array<double>, _b double"))  # at most folds² x grid rows
    away = F.zip_with("_x", F.array(*map(F.lit, center.tolist())), lambda v, m: v - m)
    logit = F.aggregate(F.zip_with(away, "_w", lambda v, w: v * w), F.col("_b"), lambda a, v: a + v)
    return rows.join(plan, F.col("fold") == F.col("_tested")).withColumn("y_score", 1 / (1 + F.exp(-logit)))


def cross_validate(df: DataFrame, features: list[str], recipe: Recipe | None = None, label: str = "label") -> DataFrame:
    """`df` with y_score and y_pred, each row scored by the model that was fitted without its fold.

    Raises for missing columns, missing values, subjects in two folds, and training rows of one class.
    """
    rows, folds = _guarded(df, features, label)
    scored = _scores(rows, folds, [(k, -1, 0) for k in folds], [recipe or Recipe()])
    return scored.withColumn("y_pred", (F.col("y_score") > 0.5).cast("int")).select(*df.columns, "y_score", "y_pred")


def _subject_metric(scored: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Balanced accuracy over subjects (mean score of their rows), per group."""
    per = scored.groupBy(*by, "subject_id").agg(F.avg("y_score").alias("s"), F.min("_label").alias("y"))
    hit = (F.col("s") >= threshold).cast("int") == F.col("y")
    rate = lambda v: F.avg(F.when(F.col("y") == v, hit.cast("double")))
    return per.groupBy(*by).agg(rate(1).alias("sens"), rate(0).alias("spec")).withColumn("score", F.coalesce((F.col("sens") + F.col("spec")) / 2, "sens", "spec"))


def select_recipes(df: DataFrame, features: list[str], grid: list[Recipe], label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(selections, trace) of nested selection: per outer fold the mean inner score of each recipe, and the best one.

    Inner scores are balanced accuracies of subjects at 0.5; ties go to the earlier recipe.
    """
    rows, folds = _guarded(df, features, label)
    return _select(rows, folds, grid)


def _select(rows: DataFrame, folds: list[int], grid: list[Recipe]) -> tuple[DataFrame, DataFrame]:
    if not grid:
        raise ValueError("the grid is empty")
    if len(folds) < 3:
        raise ValueError("nested selection needs three folds")
    tasks = [(o, i, g) for o in folds for i in folds if i != o for g in range(len(grid))]
    scored = _scores(rows, folds, tasks, grid).select("subject_id", F.col("_outer").alias("outer"), F.col("_inner").alias("inner"), F.col("_grid").alias("grid"), "y_score", F.col("_y").alias("_label"))
    trace = _subject_metric(scored, ["outer", "inner", "grid"], 0.5).groupBy("outer", "grid").agg(F.avg("score").alias("mean_score"))
    trace = written(trace, "selection-trace")
    return argmax_first(trace, ["outer"], "mean_score", "grid"), trace


def nested_cross_validate(df: DataFrame, features: list[str], grid: list[Recipe], label: str = "label", threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(subject predictions, selections): each outer fold scored by the recipe that its inner folds chose."""
    rows, folds = _guarded(df, features, label)
    selections, _ = _select(rows, folds, grid)
    chosen = [(r["outer"], -1, r["grid"]) for r in selections.collect()]  # one row per fold
    scored = _scores(rows, folds, chosen, grid)
    per = scored.groupBy("subject_id").agg(F.min(label).alias("label"), F.min("fold").alias("fold"), F.avg("y_score").alias("y_score"), F.count("*").alias("n_rows"))
    params = df.sparkSession.createDataFrame([(i, *[str(v) for v in asdict(r).values()]) for i, r in enumerate(grid)], "grid int, " + ", ".join(f"{k} string" for k in asdict(grid[0])))
    return per.withColumn("y_pred", (F.col("y_score") >= threshold).cast("int")), selections.join(F.broadcast(params), "grid")


def selection_stability(selections: DataFrame, columns: list[str]) -> DataFrame:
    """How often each combination of parameters was chosen, with its share; most frequent first, then by value."""
    total = F.sum("count").over(Window.partitionBy())
    counted = selections.groupBy(*columns).agg(F.count("*").alias("count"))
    return counted.withColumn("share", F.bround(F.col("count") / total, 2)).orderBy(F.col("count").desc(), *columns)
