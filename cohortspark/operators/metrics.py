"""Classification metrics, ROC, and bootstrap intervals, as aggregates over predictions of any number."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.draws import digest

CELLS = ("tn", "fp", "fn", "tp")


def _check_binary(df: DataFrame, *columns: str) -> None:
    row = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull() | ~F.col(c).isin(0, 1)).alias(c) for c in columns]).first()
    if not row["n"]:
        raise ValueError("no predictions")
    for c in columns:
        if row[c]:
            raise ValueError(f"{c} must be 0 or 1")


def confusion(df: DataFrame, y: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """One row: tn, fp, fn, tp."""
    cell = lambda a, b: F.count_if((F.col(y) == a) & (F.col(pred) == b))
    return df.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def _rates() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c) for c in CELLS)
    sensitivity, specificity = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return {
        "n": tn + fp + fn + tp, "n_positive": tp + fn, "accuracy": F.try_divide(tn + tp, tn + fp + fn + tp),
        "balanced_accuracy": F.coalesce((sensitivity + specificity) / 2, sensitivity, specificity),
        "sensitivity": sensitivity, "specificity": specificity, "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
    }


def classification_report(df: DataFrame, y: str = "y_true", pred: str = "y_pred", check: bool = True) -> DataFrame:
    """One row: n, n_positive, accuracy, balanced_accuracy, sensitivity, specificity, f1.

    A rate of a class without rows is null, and balanced accuracy is then the other class's. ValueError for no rows or values
    other than 0 and 1.
    """
    if check:
        _check_binary(df, y, pred)
    return confusion(df, y, pred).select(*[v.alias(k) for k, v in _rates().items()])


def _ranked(df: DataFrame, y: str, score: str, buckets: int = 200) -> DataFrame:
    """Per distinct score: positives, negatives, and how many of each have a higher score.

    Scores are cut at approximate quantiles; a window runs within each of these parts and the parts' totals give the
    offsets, so that no task sees all scores.
    """
    cells = df.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    cuts = sorted(set(cells.approxQuantile("score", [i / buckets for i in range(1, buckets)], 0.002))) or [0.0]
    part = F.size(F.filter(F.lit(cuts), lambda c: c > F.col("score")))
    cells = cells.withColumn("part", part)
    totals = cells.groupBy("part").agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over the parts, at most `buckets` rows
    offsets = F.broadcast(totals.select("part", F.coalesce(F.sum("tp").over(above), F.lit(0)).alias("op"), F.coalesce(F.sum("tn").over(above), F.lit(0)).alias("on_")))
    higher = Window.partitionBy("part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return cells.join(offsets, "part").select(
        "score", "p", "n", (F.coalesce(F.sum("p").over(higher), F.lit(0)) + F.col("op")).alias("p_above"), (F.coalesce(F.sum("n").over(higher), F.lit(0)) + F.col("on_")).alias("n_above")
    )


def auc(df: DataFrame, y: str = "y_true", score: str = "y_score") -> DataFrame:
    """One row: auc, the share of pairs ranked rightly, ties half; null where a class is missing. Exact."""
    pairs = F.sum(F.col("n") * (F.col("p_above") + F.col("p") / 2))
    return _ranked(df, y, score).agg(F.try_divide(pairs, F.sum("p") * F.sum("n")).alias("auc"))


def roc_points(df: DataFrame, y: str = "y_true", score: str = "y_score") -> DataFrame:
    """One row per distinct score: (threshold, fpr, tpr) of predicting 1 from that score on."""
    ranked = _ranked(df, y, score)
    totals = ranked.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n")).first()
    rate = lambda above, own, total: F.try_divide(F.col(above) + F.col(own), F.lit(total).cast("bigint"))
    return ranked.select(F.col("score").alias("threshold"), rate("n_above", "n", totals["all_n"]).alias("fpr"), rate("p_above", "p", totals["all_p"]).alias("tpr"))


def _rate(a: Column, b: Column) -> Column:
    return F.try_divide(a, a + b)


#: Metrics of the (weighted) confusion cells tn, fp, fn, tp. Any function of four columns will do in their place.
METRICS: dict[str, Callable[..., Column]] = {
    "balanced_accuracy": lambda tn, fp, fn, tp: (_rate(tp, fn) + _rate(tn, fp)) / 2,
    "accuracy": lambda tn, fp, fn, tp: F.try_divide(tn + tp, tn + fp + fn + tp),
    "sensitivity": lambda tn, fp, fn, tp: _rate(tp, fn),
    "specificity": lambda tn, fp, fn, tp: _rate(tn, fp),
}
#: Replicates drawn from one digest: of eight hex digits each.
DRAWS = 4
#: Rows of predictions up to which the scores of a replicate are one part.
PART_ROWS = 50_000


def poisson_limits(digits: int = 8) -> list[str]:
    """Cumulated probabilities of a Poisson number of mean 1, as hex text: a draw counts the limits that it isn't below."""
    upto, term, out = 0.0, math.exp(-1), []
    for k in range(1, 14):
        upto += term
        out.append(f"{min(16**digits - 1, int(upto * 16**digits)):0{digits}x}")
        term /= k
    return out


def resampled(df: DataFrame, key: str, n_boot: int, seed: int) -> DataFrame:
    """Each row of `df` for each `block` of DRAWS replicates, with its weights w0, w1, … there.

    A row occurs a Poisson number of times in a replicate, drawn by seed, key and replicate; resampling n of n rows gives the
    same in the limit. So no row has to meet its draw: rows are spread once, and draws are summed before they are shuffled. Rows that share a key
    are drawn together.
    """
    spread = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few predictions become many draws
    drawn = spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // DRAWS)))).withColumn("_h", digest(seed, F.col(key), F.col("block")))
    count = lambda j: sum(((F.substring("_h", 8 * j + 1, 8) >= limit).cast("int") for limit in poisson_limits()), F.lit(0))
    return drawn.withColumns({f"w{j}": count(j) for j in range(DRAWS)}).drop("_h")


def _replicates(per_block: DataFrame, columns: list[str], n_boot: int) -> DataFrame:
    """One row per replicate `b` from one row per block, whose columns end in the replicate's number."""
    each = F.array(*[F.struct((F.col("block") * DRAWS + j).alias("b"), *[F.col(f"{c}{j}").alias(c) for c in columns]) for j in range(DRAWS)])
    return per_block.select(F.inline(each)).where(F.col("b") < n_boot)


def _cell_values(df: DataFrame, key: str, preds: dict[str, str], y: str, metric: Callable[..., Column], n_boot: int, seed: int) -> DataFrame:
    """(b, one column per prediction): the metric in each replicate; null where the replicate holds one class only."""
    narrow = df.select(key, F.col(y).alias("_y"), *[F.col(p).alias(f"_p_{name}") for name, p in preds.items()])
    sums, names = [], []
    for name in preds:
        for cell, (t, p) in zip(CELLS, ((0, 0), (0, 1), (1, 0), (1, 1))):
            names.append(f"{name}_{cell}_")
            sums += [F.sum(F.when((F.col("_y") == t) & (F.col(f"_p_{name}") == p), F.col(f"w{j}")).otherwise(0)).alias(f"{name}_{cell}_{j}") for j in range(DRAWS)]
    per = _replicates(resampled(narrow, key, n_boot, seed).groupBy("block").agg(*sums), names, n_boot)

    def value(name: str) -> Column:
        tn, fp, fn, tp = (F.col(f"{name}_{c}_") for c in CELLS)
        return F.when((tn + fp > 0) & (fn + tp > 0), metric(tn, fp, fn, tp))

    return per.select("b", *[value(name).alias(name) for name in preds])


def _score_parts(df: DataFrame, score: str) -> Column:
    """A part for each range of scores, so that no window holds those of all rows."""
    parts = df.count() // PART_ROWS
    cuts = sorted(set(df.approxQuantile(score, [i / (parts + 1) for i in range(1, parts + 1)], 0.002))) if parts else []
    return F.size(F.filter(F.lit(cuts), lambda c: c < F.col(score))) if cuts else F.lit(0)


def _auc_values(df: DataFrame, key: str, y: str, score: str, n_boot: int, seed: int) -> DataFrame:
    """(b, value): the area under the curve in each replicate, ties half; null where it holds one class only."""
    known = df.where(F.col(score).isNotNull() & ~F.isnan(score)).select(key, F.col(y).alias("_y"), F.col(score).cast("double").alias("_s"))
    known = known.withColumn("_part", _score_parts(known, "_s"))
    both = lambda cls, j: F.sum(F.when(F.col("_y") == cls, F.col(f"w{j}")).otherwise(0))
    cells = resampled(known, key, n_boot, seed).groupBy("block", "_part", "_s").agg(*[both(c, j).alias(f"{n}{j}") for j in range(DRAWS) for c, n in ((1, "p"), (0, "n"))])
    lower = Window.partitionBy("block", "_part").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    below = cells.withColumns({f"l{j}": F.coalesce(F.sum(f"n{j}").over(lower), F.lit(0)) for j in range(DRAWS)})
    parts = below.groupBy("block", "_part").agg(*[x for j in range(DRAWS) for x in (F.sum(F.col(f"p{j}") * (2 * F.col(f"l{j}") + F.col(f"n{j}"))).alias(f"won{j}"), F.sum(f"p{j}").alias(f"p{j}"), F.sum(f"n{j}").alias(f"n{j}"))])
    before = Window.partitionBy("block").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({f"l{j}": F.coalesce(F.sum(f"n{j}").over(before), F.lit(0)) for j in range(DRAWS)})
    per = parts.groupBy("block").agg(*[x for j in range(DRAWS) for x in (F.sum(F.col(f"won{j}") + 2 * F.col(f"p{j}") * F.col(f"l{j}")).alias(f"won{j}"), F.sum(f"p{j}").alias(f"p{j}"), F.sum(f"n{j}").alias(f"n{j}"))])
    return _replicates(per, ["won", "p", "n"], n_boot).select("b", F.try_divide(F.col("won"), 2 * F.col("p") * F.col("n")).alias("value"))


def _interval(values: DataFrame, point: DataFrame, alpha: float) -> DataFrame:
    bounds = F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    found = values.where(F.col("value").isNotNull()).agg(bounds[0].alias("lower"), bounds[1].alias("upper"), F.count("*").alias("n_eff"))
    return point.select(F.col("point").cast("double").alias("point")).join(F.broadcast(found))  # one row each


def _within(n_boot: int, alpha: float, metric) -> Callable[..., Column] | None:
    if n_boot < 1 or not 0 < alpha < 1 or not (metric == "auc" or metric in METRICS or callable(metric)):
        raise ValueError("n_boot, alpha or metric is out of range")
    return None if metric == "auc" else METRICS.get(metric, metric)


def bootstrap_ci(df: DataFrame, metric: str | Callable[..., Column] = "balanced_accuracy", n_boot: int = 2000, alpha: float = 0.05, seed: int = 42, y: str = "y_true", pred: str = "y_pred", score: str = "y_score", key: str = "subject_id") -> DataFrame:
    """One row: point, lower, upper, n_eff. Replicates with one class only are left out; bounds are null if none are left.

    `metric` is one of METRICS, `auc` (of `score`), or a function of the confusion cells. `key` tells the rows apart.
    """
    of_cells = _within(n_boot, alpha, metric)
    if of_cells is None:
        _check_binary(df, y)
        return _interval(_auc_values(df, key, y, score, n_boot, seed), auc(df, y, score).withColumnRenamed("auc", "point"), alpha)
    _check_binary(df, y, pred)
    values = _cell_values(df, key, {"value": pred}, y, of_cells, n_boot, seed)
    return _interval(values, confusion(df, y, pred).select(of_cells(*map(F.col, CELLS)).alias("point")), alpha)


def bootstrap_difference(df: DataFrame, a: str, b: str, metric: str | Callable[..., Column] = "balanced_accuracy", n_boot: int = 2000, alpha: float = 0.05, seed: int = 42, y: str = "y_true", key: str = "subject_id") -> DataFrame:
    """As bootstrap_ci, of metric(b) - metric(a), both on the same draws; `a` and `b` are predictions, or scores for `auc`."""
    of_cells = _within(n_boot, alpha, metric)
    if of_cells is None:
        _check_binary(df, y)
        both = [_auc_values(df, key, y, c, n_boot, seed).withColumnRenamed("value", n) for c, n in ((a, "va"), (b, "vb"))]
        values = both[0].join(both[1], "b")
        point = auc(df, y, a).withColumnRenamed("auc", "va").join(F.broadcast(auc(df, y, b).withColumnRenamed("auc", "vb")))  # one row each
    else:
        _check_binary(df, y, a, b)
        values = _cell_values(df, key, {"va": a, "vb": b}, y, of_cells, n_boot, seed)
        point = confusion(df, y, a).select(of_cells(*map(F.col, CELLS)).alias("va")).join(F.broadcast(confusion(df, y, b).select(of_cells(*map(F.col, CELLS)).alias("vb"))))
    return _interval(values.select("b", (F.col("vb") - F.col("va")).alias("value")), point.select((F.col("vb") - F.col("va")).alias("point")), alpha)


def format_ci(point: Column, lower: Column, upper: Column, digits: int = 3) -> Column:
    """`p [lower, upper]`; the point alone where a bound is missing, `n/a` where the point is."""
    gone = lambda c: c.isNull() | F.isnan(c)
    one = f"%.{digits}f"
    return F.when(gone(point), "n/a").when(gone(lower) | gone(upper), F.format_string(one, point)).otherwise(F.format_string(f"{one} [{one}, {one}]", point, lower, upper))


def beats_chance(lower: Column, chance: float = 0.5) -> Column:
    return F.coalesce(~F.isnan(lower) & (lower > chance), F.lit(False))
