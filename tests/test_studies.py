import numpy as np
from pyspark.sql import functions as F

from cohortspark.operators import controls, studies
from cohortspark.operators.logistic import Recipe


def frame(spark, separation, n=30):
    rng = np.random.default_rng(1)
    rows = [(f"S{i:03d}", i % 2, (i // 2) % 5, float(rng.normal(i % 2 * separation)), float(rng.normal())) for i in range(2 * n)]
    return spark.createDataFrame(rows, "subject_id string, label int, fold int, a double, b double")


def test_sets_and_control(spark):
    df = frame(spark, 4)
    got = {r.name: r for r in studies.against_probe(studies.evaluate_sets(df, {"a": ["a"], "b": ["b"]}, control="a", n_boot=200)).collect()}
    assert set(got) == {"a", "b", "a (shuffled)"} and got["a"].balanced_accuracy > 0.9 and got["a"].above_chance
    assert 0.2 < got["a (shuffled)"].balanced_accuracy < 0.8 and abs(got["a"].auc_delta - (got["a"].auc - 0.756)) < 1e-9


def test_control_of_subjects_with_several_rows(spark):
    df = frame(spark, 4, 15)
    slices = df.union(df.withColumn("a", F.col("a") + 0.1))
    dealt = controls.shuffle_by_subject(slices, seed=3)
    per = dealt.groupBy("subject_id").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"), F.min("label").alias("label")).collect()
    assert {(r.n, r.labels) for r in per} == {(2, 1)} and sum(r.label for r in per) == 15
    assert dealt.join(slices.select("subject_id", F.col("label").alias("old")), "subject_id").where("label != old").count() > 0
    got = {r.name: r.n for r in studies.evaluate_sets(slices, {"a": ["a"]}, control="a", n_boot=50).collect()}
    assert got == {"a": 30, "a (shuffled)": 30}


def test_comparison_collinearity_and_refit(spark):
    df = frame(spark, 3).withColumn("c", F.col("a") * 2)
    ranked = studies.compare_recipes(df, {"good": ["a"], "bad": ["b"]}, {"good": [Recipe(c=1.0)], "bad": [Recipe(c=1.0, k=5)]}, n_boot=50).collect()
    assert [r.name for r in ranked] == ["good", "bad"]
    near = {r.feature: (r.nearest, round(r.abs_r, 6)) for r in studies.collinearity(df, ["a", "b", "c"]).collect()}
    assert near["a"] == ("c", 1.0) and near["c"] == ("a", 1.0)
    model, meta = studies.final_refit(df, ["a", "b"], [Recipe(c=0.01), Recipe(c=1.0)])
    assert model["features"] == meta.inputs == ["a", "b"] and meta.scores["balanced_accuracy"] > 0.8 and meta.subjects == 60
