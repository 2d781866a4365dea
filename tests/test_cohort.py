import random

import numpy as np

import pytest
from pyspark.sql import functions as F

from cohortspark.functions.ids import session_key, subject_key
from cohortspark.operators import aggregate, controls, folds, joins, manifest, metrics, reports
from cohortspark.plans import cohort_queries
from cohortspark.sources import images


def test_ids(spark):
    rows = [("OAS1_00000012", "MR1", None), (" oas1-12", "mr 03", None), ("OAS１_０００１２", "MR-1", None), (" OAS1.00000012", None, "disc2/OAS1_00000012_MR07.hdr"), (None, None, "oas1 00000012 mr2"), (None, None, None), ("nothing", "x", "y"), ("OAS1_123456789", "MR10", None)]
    got = spark.createDataFrame(rows, "s string, m string, r string").select(subject_key(F.col("s"), F.col("r")), session_key(F.col("m"), F.col("r"))).collect()
    one = "OAS1_00000012"
    assert [tuple(r) for r in got] == [(one, "MR1"), (one, "MR3"), (one, "MR1"), (one, "MR7"), (one, "MR2"), (None, None), (None, None), ("OAS1_123456789", "MR10")]


RAW = "ID string, `M/F` string, Hand string, Age int, Educ double, SES double, MMSE double, CDR double, eTIV int, nWBV double, ASF double"


def sheet(spark, *rows):
    return spark.createDataFrame([(i, "F", "R", age, 2.0, float("nan"), 29.0, cdr, 1344, 0.743, 1.306) for i, age, cdr in rows], RAW)


def test_labels_and_manifest(spark):
    nan = float("nan")
    values = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 2.0, 0.25, -1.0, nan, None)], "c double")
    assert [r[0] for r in values.select(manifest.derive_label(F.col("c"))).collect()] == [0, 1, 1, 1, None, None, None, None]
    raw = sheet(spark, ("OAS1_0001_MR1", 25, 0.0), ("OAS1_0002_MR1", 70, 0.0), (" OAS1_0003_MR2", 45, 1.0), ("not-an-id", 50, nan))
    got = {r.subject_id: r for r in manifest.add_control_eligibility(manifest.build_manifest(raw)).collect()}
    assert {k: (r.label, r.age_matched_cohort, r.ses) for k, r in got.items()} == {"OAS1_0001": (0, False, None), "OAS1_0002": (0, True, None), "OAS1_0003": (1, True, None)}
    assert got["OAS1_0003"].raw_id == " OAS1_0003_MR2"
    with pytest.raises(Exception, match="not a session id"):
        manifest.build_manifest(sheet(spark, ("not-an-id", 50, 1.0))).collect()
    with pytest.raises(ValueError, match="CDR"):
        manifest.build_manifest(raw.drop("CDR"))
    assert manifest.violations(manifest.build_manifest(raw)).first().subject_id_missing == 0


def subjects(spark, n, extra=()):
    return spark.createDataFrame([(f"S{i:03d}", i % 2, 65 + i % 20) for i in range(2 * n)] + list(extra), "subject_id string, label int, age int")


def test_folds(spark):
    df = subjects(spark, 23)
    assigned = folds.assign_subject_folds(df, 5)
    per = [r for r in assigned.groupBy("fold", "label").count().collect()]
    assert assigned.count() == 46 and {r["count"] for r in per} <= {4, 5} and len({r.fold for r in per}) == 5
    assert {r["count"] for r in assigned.groupBy("fold").count().collect()} <= {9, 10}
    assert sorted(map(tuple, assigned.collect())) == sorted(map(tuple, folds.assign_subject_folds(df.repartition(7), 5).collect()))
    rows = df.union(df).union(df).union(df)
    attached = folds.attach_folds(rows, assigned)
    assert attached.count() == rows.count()
    folds.assert_no_subject_leakage(attached)
    summary = folds.summarize_folds(attached).collect()
    assert len(summary) == 5 and sum(r.n_subjects for r in summary) == 46 and sum(r.n_rows for r in summary) == 184
    train, test = folds.train_test(attached, 2)
    assert train.count() + test.count() == 184 and train.join(test, "subject_id", "left_semi").count() == 0
    with pytest.raises(ValueError, match="no fold"):
        folds.train_test(attached, 99)
    with pytest.raises(ValueError, match="without fold"):
        folds.attach_folds(subjects(spark, 23, [("new", 1, 60)]), assigned)
    with pytest.raises(ValueError, match="smallest class"):
        folds.assign_subject_folds(subjects(spark, 3), 5)
    with pytest.raises(ValueError, match="conflicting labels"):
        folds.assign_subject_folds(subjects(spark, 9, [("S000", 1, 60)]), 5)
    with pytest.raises(ValueError, match="at least 2"):
        folds.assign_subject_folds(df, 1)
    leaked = spark.createDataFrame([("A", 0), ("A", 1), ("B", 0), ("B", 1), ("C", 0)], "subject_id string, fold int")
    with pytest.raises(ValueError, match="leakage detected: 2 subject"):
        folds.assert_no_subject_leakage(leaked)
    with pytest.raises(KeyError):
        folds.assert_no_subject_leakage(leaked.drop("fold"))


def test_shuffles_keep_counts(spark):
    assigned = folds.assign_subject_folds(subjects(spark, 40), 5)
    whole, within = controls.shuffle_labels(assigned, "subject_id", seed=3), controls.shuffle_labels(assigned, "subject_id", seed=3, within="fold")
    counts = lambda df, *k: sorted(map(tuple, df.groupBy(*k).count().collect()))
    assert counts(whole, "label") == counts(assigned, "label") and counts(within, "fold", "label") == counts(assigned, "fold", "label")
    assert sorted(map(tuple, whole.collect())) != sorted(map(tuple, assigned.select(*whole.columns).collect()))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, controls.shuffle_labels(assigned.repartition(5), "subject_id", seed=3).collect()))


def slices(spark, scores, **more):
    rows = [(s, 1, 0, i, v) for s, vs in scores.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "subject_id string, label int, fold int, position int, y_score double")


def test_aggregation(spark):
    df = slices(spark, {"a": [0.2, 0.3, 0.95], "b": [0.9, 0.9, 0.1, 0.1], "c": [0.8, 0.7, 0.9], "d": [None, float("nan")]})
    got = {m: {r.subject_id: r for r in aggregate.aggregate_predictions(df, m).collect()} for m in ("mean", "median", "max")}
    assert (got["mean"]["a"].y_pred, got["max"]["a"].y_pred, got["median"]["a"].y_score) == (0, 1, 0.3)
    assert got["mean"]["d"].y_score is None and got["mean"]["d"].n_slices == 0
    agree = {r.subject_id: r for r in aggregate.slice_agreement(df).collect()}
    assert (agree["b"].majority, agree["b"].agreement) == (0, 0.5) and agree["c"].agreement == 1.0 and "d" not in agree
    for bad in ({"method": "sum"}, {"threshold": 1.0}):
        with pytest.raises(ValueError):
            aggregate.aggregate_predictions(df, **bad)
    with pytest.raises(ValueError, match="more than one label"):
        aggregate.aggregate_predictions(df.withColumn("label", F.col("position") % 2))


def test_metrics(spark):
    frame = lambda y, p: spark.createDataFrame(list(zip(y, p)), "y_true int, y_pred int")
    r = metrics.classification_report(frame([1] * 90 + [0] * 10, [1] * 100)).first()
    assert (r.accuracy, r.balanced_accuracy, r.specificity) == (0.9, 0.5, 0.0)
    r = metrics.classification_report(frame([1, 1, 1, 0, 0, 0], [1, 1, 0, 0, 0, 1])).first()
    assert r.sensitivity == r.specificity == pytest.approx(2 / 3)
    assert tuple(metrics.confusion(frame([0, 0, 1, 1], [0, 1, 0, 1])).first()) == (1, 1, 1, 1)
    assert metrics.classification_report(frame([1, 1], [1, 0])).first().balanced_accuracy == 0.5
    for bad in (frame([], []), frame([0, 2], [0, 1])):
        with pytest.raises(ValueError):
            metrics.classification_report(bad)


def test_auc_is_the_share_of_ordered_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 1), rng.randint(0, 40) / 16) for _ in range(500)]
    df = spark.createDataFrame(rows, "y_true int, y_score double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert metrics.auc(df).first().auc == pytest.approx(want, abs=1e-12)
    points = metrics.roc_points(df).orderBy("threshold").collect()
    assert points[0].fpr == points[0].tpr == 1.0
    for r in points[::5]:
        assert r.tpr == pytest.approx(sum(p >= r.threshold for p in pos) / len(pos))
    assert metrics.auc(df.where("y_true = 1")).first().auc is None


def test_bootstrap(spark):
    flip = spark.createDataFrame([(i, i % 2, (i // 2) % 2, 1 - i % 2) for i in range(200)], "subject_id int, y_true int, y_pred int, wrong int")
    ci = metrics.bootstrap_ci(flip, n_boot=500).first()
    assert ci.lower < 0.5 < ci.upper and ci.n_eff == 500
    assert ci == metrics.bootstrap_ci(flip, n_boot=500).first()
    good = spark.createDataFrame([(i, i % 2, i % 2 if i % 10 else 1 - i % 2) for i in range(300)], "subject_id int, y_true int, y_pred int")
    assert metrics.bootstrap_ci(good, n_boot=300).first().lower > 0.5
    diff = metrics.bootstrap_difference(flip, "wrong", "y_pred", n_boot=300).first()
    assert diff.point == 0.5 and diff.lower > 0
    own = metrics.bootstrap_ci(good, lambda tn, fp, fn, tp: tp / (tp + fp), n_boot=100).first()
    assert own.lower < own.point < own.upper and own.point == pytest.approx(5 / 6)
    one = spark.createDataFrame([(i, 1, 1) for i in range(5)], "subject_id int, y_true int, y_pred int")
    assert metrics.bootstrap_ci(one, n_boot=20).first().n_eff == 0
    text = spark.createDataFrame([(0.5, 0.4, 0.6), (None, 0.1, 0.2), (0.5, None, 0.2)], "p double, l double, u double")
    shown = text.select(metrics.format_ci(F.col("p"), F.col("l"), F.col("u")), metrics.beats_chance(F.col("l"))).collect()
    assert [tuple(r) for r in shown] == [("0.500 [0.400, 0.600]", False), ("n/a", False), ("0.500", False)]


def test_bootstrap_of_scores(spark, monkeypatch):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300)
    a, b = np.round(y * 0.5 + rng.normal(size=300), 1), np.round(y * 1.5 + rng.normal(size=300), 1)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(y, a, b))], "subject_id int, y_true double, a double, b double").withColumn("y_true", F.col("y_true").cast("int"))

    def area(y, s):
        pos, neg = s[y == 1], s[y == 0]
        return ((pos[:, None] > neg) + (pos[:, None] == neg) / 2).mean()

    draws = [rng.integers(0, 300, 300) for _ in range(1000)]
    want = np.percentile([area(y[d], a[d]) for d in draws], [2.5, 97.5])
    got = metrics.bootstrap_ci(df, "auc", n_boot=1000, score="a").first()
    assert got.point == pytest.approx(area(y, a)) and np.allclose([got.lower, got.upper], want, atol=0.015) and got.n_eff == 1000
    both = metrics.bootstrap_difference(df, "a", "b", "auc", n_boot=400).first()
    assert both.point == pytest.approx(area(y, b) - area(y, a)) and 0 < both.lower < both.point < both.upper
    monkeypatch.setattr(metrics, "PART_ROWS", 40)  # several parts of scores
    assert tuple(metrics.bootstrap_ci(df, "auc", n_boot=1000, score="a").first()) == pytest.approx(tuple(got))
    with pytest.raises(ValueError):
        metrics.bootstrap_ci(df, "unknown")


def test_joins(spark):
    a, b = spark.createDataFrame([(1, 2, "x"), (2, 3, "y")], "k int, v int, o string"), spark.createDataFrame([(1, 5), (1, 6)], "k int, v int")
    with pytest.raises(ValueError, match="not unique"):
        joins.many_to_one_join(a, b, ["k"])
    with pytest.raises(ValueError):
        joins.one_to_one_join(b, a, ["k"])
    assert joins.suffix_join(a, b, ["k"], ("_l", "_r")).columns == ["k", "v_l", "o", "v_r"]
    assert {r.k: r.got for r in joins.lookup(a, b.where("v = 5"), "k", "v", "got").collect()} == {1: 5, 2: None}
    assert [r.k for r in joins.absent(a, b, "k").collect()] == [2]
    counts = spark.createDataFrame([(0, 4), (9, 1)], "fold int, n int")
    assert {r.fold: r.n for r in joins.completed(counts, spark.createDataFrame([(0,), (1,)], "fold int"), "fold", ["n"]).collect()} == {0: 4, 1: 0}


def test_images(spark):
    stem = "OAS1_0001_MR1"
    path = lambda k, disc="disc1", s=stem, tail="masked_gfc.img": f"{disc}/{s}/PROCESSED/MPRAGE/T88_111/{s}_mpr_n{k}_anon_111_t88_{tail}"
    files = [(path(3), 9), (path(3), 9), (path(4, s="OAS1_0002_MR1"), 9), (path(3, s="OAS1_0002_MR1"), 9), (path(4, s="OAS1_0003_MR1"), 0), (path(4, s="x_OAS1_0004_MR1"), 9), (path(4, "other"), 9), (path(4, tail="gfc.img"), 9), (path(4, tail="masked_gfc.hdr"), 9)]
    found = images.find_images(spark.createDataFrame(files, "image_path string, size_bytes bigint"))
    assert {r.raw_id: r.n_images for r in found.collect()} == {stem: 1, "OAS1_0002_MR1": 2}
    with pytest.raises(ValueError, match="Ambiguous"):
        images.assert_unambiguous(found)
    known = spark.createDataFrame([(stem,), ("OAS1_0009_MR1",)], "raw_id string")
    got = {r.raw_id: (r.image_path, r.image_available) for r in images.attach_images(known, found).collect()}
    assert got == {stem: (path(3), True), "OAS1_0009_MR1": ("", False)}
    with pytest.raises(ValueError):
        images.image_pattern("unknown")


def test_several_images_are_not_none(spark):
    found = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "raw_id string, n_images bigint, image_path string")
    attached = images.attach_images(spark.createDataFrame([("a", 0, 1), ("b", 1, 1), ("c", 0, 1)], "raw_id string, label int, fold int"), found)
    assert {r.raw_id: (r.image_path, r.image_available, r.image_ambiguous) for r in attached.collect()} == {"a": ("x", True, False), "b": ("", True, True), "c": ("", False, False)}
    r = reports.image_states_by(attached, "fold").first()
    assert (r.n, r.n_demented, r.n_one, r.n_ambiguous, r.n_none, r.n_cn) == (3, 1, 1, 1, 1, 2)


def test_excluded_subjects_are_counted(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 0, 0), ("a", 1, 0), ("b", 1, 0), ("b", 1, 1), ("b", 1, 2), ("c", 0, 0), ("c", 1, 1), ("d", 0, 3)], "subject_id string, label int, fold int")
    monkeypatch.setattr(cohort_queries, "_slices", lambda spark, sf: rows)
    got = {(r.label_conflict, r.fold_conflict): (r.n_subjects, r.n_slices) for r in cohort_queries.slice_exclusions(spark, "").collect()}
    assert got == {(True, False): (1, 2), (False, True): (1, 3), (True, True): (1, 2)}


def test_reports(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 3.0, 1.0), (1, 5.0, None), (1, float("nan"), 4.0), (None, 1.0, 1.0)], "label int, a double, b double")
    assert [tuple(r) for r in reports.value_counts(df, ["label"], share=True).collect()] == [(0, 2, 0.5), (1, 2, 0.5)]
    assert reports.value_counts(df, ["label"], dropna=False).count() == 3
    assert {r.feature: r.mean for r in reports.describe(df, ["a", "b"]).collect()} == {"a": 2.5, "b": 2.0}
    delta = {r.feature: r.delta for r in reports.group_deltas(df, ["a", "b"]).collect()}
    assert delta == {"a": 3.0, "b": 2.5}
    trace = spark.createDataFrame([("o", 0, 0.5), ("o", 1, 0.7), ("o", 2, 0.7)], "outer string, grid int, score double")
    assert reports.argmax_first(trace, ["outer"], "score", "grid").first().grid == 1
    assert reports.correlations(df.where("label = 0"), ["a", "b"]).first().r == pytest.approx(-1.0)
    assert [r.score for r in reports.rank_by(spark.createDataFrame([(1.0,), (-3.0,), (2.0,)], "score double"), "score", absolute=True).collect()] == [-3.0, 2.0, 1.0]
