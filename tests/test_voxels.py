import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import crossval, embed, features, logistic, segment, voxels
from cohortspark.operators.logistic import Recipe
from cohortspark.plans import model_queries
from cohortspark.sources import artifact
from cohortspark.sources import volumes as volume_files


def frame(spark, *arrays):
    return spark.createDataFrame([(i, [int(n) for n in a.shape], [float(x) for x in a.ravel()]) for i, a in enumerate(arrays)], "subject_id int, shape array<int>, data array<double>")


def value(df, column):
    return np.array(df.select(column.alias("x")).first().x)


def test_intensity(spark):
    rng = np.random.default_rng(42)
    a = rng.normal(size=(8, 10, 12))
    df, d = frame(spark, a), F.col("data")
    lo, hi = np.percentile(a, [1, 99])
    assert np.allclose(value(df, voxels.clip_percentile(d)), np.clip(a, lo, hi).ravel())
    assert np.allclose(value(df, voxels.minmax(d)), ((a - a.min()) / (a.max() - a.min())).ravel())
    front = a[a > 0]
    assert np.allclose(value(df, voxels.zscore(d)), ((a - front.mean()) / front.std()).ravel())
    flat = frame(spark, np.full((2, 2, 2), -3.0))
    assert not value(flat, voxels.minmax(d)).any() and not value(flat, voxels.zscore(d)).any()
    with pytest.raises(ValueError):
        voxels.clip_percentile(d, 50, 50)
    with pytest.raises(ValueError):
        voxels.preprocess(d, "none")


def test_planes(spark):
    a = np.random.default_rng(0).normal(size=(3, 4, 5))
    df, d, s = frame(spark, a), F.col("data"), F.col("shape")
    for axis in range(3):
        assert np.allclose(value(df, voxels.plane(d, s, axis, 1)), np.take(a, 1, axis).ravel())
    with pytest.raises(Exception, match="outside axis"):
        value(df, voxels.plane(d, s, 0, 3))
    one = lambda c: list(value(df, c))
    assert one(voxels.central_indices(F.lit(12), 3)) == [5, 6, 7] and one(voxels.central_indices(F.lit(12), 3, 2)) == [4, 6, 8]
    with pytest.raises(Exception, match="don't fit"):
        one(voxels.central_indices(F.lit(4), 5))
    assert voxels.triplanar_offsets(3, 4) == [-4, 0, 4] and voxels.triplanar_offsets(4, 1) == [-1, 0, 1, 2]
    assert one(voxels.channel_indices(F.lit(0), "adjacent", F.lit(4))) == [0, 0, 1]
    tri = value(df, voxels.triplanar_sample(d, s, 0)).reshape(3, 5, 5)
    assert np.allclose(tri[2][1:4, 0:4], a[:, :, 2]) and tri.shape == (3, 5, 5) and not tri[2][0].any()
    assert one(voxels.squeeze(F.array(*map(F.lit, (4, 1, 5, 1, 1))))) == [4, 1, 5] and one(voxels.squeeze(F.array(*map(F.lit, (4, 1, 5, 2))))) == [4, 1, 5, 2]
    with pytest.raises(Exception, match="3 dimensions"):
        one(voxels.require_volume(F.array(*map(F.lit, (4, 1, 5, 2)))))


def seg_frame(spark, *arrays):
    return frame(spark, *arrays).select("subject_id", "shape", F.transform("data", lambda v: v.cast("int")).alias("seg"))


def test_tissue_and_regions(spark):
    flat = np.repeat([0, 1, 2, 3], [400, 100, 300, 200]).reshape(10, 10, 10)
    r = features.tissue_features(seg_frame(spark, flat)).first()
    assert (r.background_voxels, r.csf_voxels, r.grey_matter_voxels, r.white_matter_voxels, r.intracranial_voxels) == (400, 100, 300, 200, 600)
    assert (r.gm_csf_ratio, r.gm_wm_ratio, r.brain_csf_ratio) == (3.0, 1.5, 5.0)
    none = features.tissue_features(seg_frame(spark, np.zeros((2, 2, 2)))).first()
    assert none.csf_fraction == none.gm_csf_ratio == 0.0
    with pytest.raises(Exception, match="unknown label"):
        features.tissue_features(seg_frame(spark, np.full((2, 2, 2), 7))).collect()
    with pytest.raises(Exception, match="shorter"):
        features.block_counts(seg_frame(spark, flat), "subject_id", n=11).collect()
    mixed = seg_frame(spark, flat, np.zeros((2, 3, 4))).withColumn("seg", F.when(F.col("subject_id") < 2, F.col("seg"))).union(seg_frame(spark, flat).withColumns({"subject_id": F.lit(2), "seg": F.lit(None).cast("array<int>")}))
    assert [(r.subject_id, r.csf_voxels) for r in features.tissue_features(mixed).orderBy("subject_id").collect()] == [(0, 100), (1, 0), (2, None)]
    assert features.block_counts(mixed, "subject_id", n=2).count() == 16 and features.tissue_features(mixed.limit(0)).count() == 0
    for size, n in ((9, 3), (10, 3), (11, 3), (122, 14)):
        bounds = features.block_bounds(size, n)
        assert bounds[0][0] == 0 and bounds[-1][1] == size and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))
    a = np.random.default_rng(1).integers(0, 4, (9, 10, 11))
    got = {(r.i, r.j, r.k): r for r in features.block_counts(seg_frame(spark, a), "subject_id", n=3).collect()}
    for (i, j, k), r in got.items():
        (x0, x1), (y0, y1), (z0, z1) = features.block_bounds(9, 3)[i], features.block_bounds(10, 3)[j], features.block_bounds(11, 3)[k]
        part = a[x0:x1, y0:y1, z0:z1]
        assert (r.voxels, r.csf, r.grey_matter, r.white_matter) == (part.size, *[(part == t).sum() for t in (1, 2, 3)])
    half = np.full((8, 8, 8), 2)
    half[:4] = 1
    blocks = features.block_counts(seg_frame(spark, half), "subject_id", n=2)
    vector = features.regional_vector(blocks, "subject_id", 2).first().features
    assert vector["asym_grey_matter_b0_0_0"] == -1.0 and len(vector) == 24 + 12 + 8
    names = spark.createDataFrame([("csf_b1_2_10",), ("none",), ("x_b1_2",)], "n string").select(features.block_index(F.col("n"))).collect()
    assert [r[0] and tuple(r[0]) for r in names] == [(1, 2, 10), None, None]


def test_dice(spark):
    df = spark.createDataFrame([([1, 1, 2, 0], [1, 2, 2, 0])], "a array<int>, b array<int>")
    r = features.segmentation_agreement(df, "a", "b").first()
    assert (r.dice_csf, r.dice_grey_matter, r.dice_white_matter) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 1.0)


def test_mixture_and_segmentation(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.02, 500) for m in (0.8, 0.1, 0.5)])
    assert np.allclose(segment.fit_mixture(x)[1], [0.1, 0.5, 0.8], atol=0.01)
    truth = np.zeros((20, 20, 20), dtype=int)
    for t, (lo, hi) in enumerate(((2, 8), (8, 14), (14, 18)), 1):
        truth[lo:hi, 2:18, 2:18] = t
    brain = np.where(truth > 0, np.clip(np.choose(truth, [0, 0.15, 0.5, 0.85]) + rng.normal(0, 0.02, truth.shape), 0.01, 1), 0.0)
    got = value(segment.segment_volumes(frame(spark, brain)), F.col("seg")).reshape(truth.shape)
    for t in (1, 2, 3):
        assert 2 * ((got == t) & (truth == t)).sum() / ((got == t).sum() + (truth == t).sum()) > 0.9
    assert ((got == 0) == (truth == 0)).all() and not segment.segment(np.zeros(5)).any()
    with pytest.raises(ValueError):
        segment.fit_mixture(np.array([1.0, 2.0]))


def test_embedding(spark):
    a = np.random.default_rng(0).uniform(size=(6, 7, 6))
    df = frame(spark, a, a + 1).withColumn("fold", F.col("subject_id"))
    out = embed.embed_cohort(df, ["subject_id", "fold"], embed.backbone("projection_64"), n=3, step=2).collect()
    assert len(out) == 6 and {len(r.embedding) for r in out} == {64} and sorted({r.position for r in out}) == [1, 3, 5]
    wrong = embed.Backbone("wrong", 5, 8, embed.random_projection(6, 8))
    with pytest.raises(Exception, match="declares 5"):
        embed.embed_cohort(df, ["subject_id"], wrong, n=1).collect()
    with pytest.raises(ValueError):
        embed.register("mine", embed.random_projection(6, 8))
    with pytest.raises(ValueError):
        embed.backbone("resnet18")
    assert embed.register("mine", embed.random_projection(6, 8), 6, 8) is embed.backbone("mine")
    assert embed.embedding_columns(["emb_10", "emb_2", "emb_x", "emb_0", "id"]) == ["emb_0", "emb_2", "emb_10"]
    assert np.allclose(embed.resize(np.arange(4.0).reshape(1, 1, 2, 2), 4)[0, 0, 0], [0, 0.25, 0.75, 1])


def cv_frame(spark, separation, n=50):
    rng = np.random.default_rng(0)
    rows = [(f"S{i:04d}", i % 2, (i // 2) % 5, float(rng.normal(i % 2 * separation, 1)), float(rng.normal())) for i in range(2 * n)]
    return spark.createDataFrame(rows, "subject_id string, label int, fold int, feat_a double, feat_b double")


def test_logistic_is_a_minimum(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(80, 3)), rng.integers(0, 2, 80)
    w = logistic.newton(x, y, 0.5)
    weight = np.where(y == 1, 80 / (2 * y.sum()), 80 / (2 * (80 - y.sum())))
    loss = lambda v: 0.5 * v[:3] @ v[:3] + 0.5 * (weight * (np.logaddexp(0, x @ v[:3] + v[3]) - y * (x @ v[:3] + v[3]))).sum()
    for _ in range(50):
        assert loss(w) <= loss(w + rng.normal(0, 1e-3, 4)) + 1e-12
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, label int")
    model, z = logistic.fit_large(df, ["a", "b", "c"], c=0.5), (x - x.mean(0)) / x.std(0)
    assert np.allclose([*model["coefficients"], model["intercept"]], logistic.newton(z, y, 0.5), atol=1e-4)
    with pytest.raises(ValueError):
        Recipe(c=0)


def test_cross_validation(spark):
    accuracy = lambda df: np.mean([r.y_pred == r.label for r in crossval.cross_validate(df, ["feat_a", "feat_b"]).collect()])
    assert accuracy(cv_frame(spark, 4)) > 0.9 and 0.25 < accuracy(cv_frame(spark, 0)) < 0.75
    df = cv_frame(spark, 1)
    for bad, message in ((df.withColumn("feat_a", F.when(F.col("fold") > 0, F.col("feat_a"))), "null"), (df.drop("feat_b"), "missing"), (df.union(df.withColumn("fold", (F.col("fold") + 1) % 5)), "leakage"), (df.where("fold > 0 or label = 1").where("fold = 0 or label = 0"), "single class")):
        with pytest.raises(ValueError, match=message):
            crossval.cross_validate(bad, ["feat_a", "feat_b"])


def test_embed_cv_fits_every_column(spark, sf, monkeypatch):
    fitted = []

    def cross_validate(df, names, recipe):
        fitted.extend(names)
        return df.withColumns({"y_score": F.lit(0.5), "y_pred": F.lit(1)})

    monkeypatch.setattr(crossval, "cross_validate", cross_validate)
    model_queries.embed_cv(spark, sf)
    assert fitted == [f"emb_{i}" for i in range(embed.backbone("projection_64").dim)]


def test_distributed_and_grouped_fits_agree(spark, monkeypatch):
    df = cv_frame(spark, 1)
    small = {r.subject_id: r.y_score for r in crossval.cross_validate(df, ["feat_a", "feat_b"]).collect()}
    monkeypatch.setattr(crossval, "MAX_TRAINING_ROWS", 10)
    large = {r.subject_id: r.y_score for r in crossval.cross_validate(df, ["feat_a", "feat_b"]).collect()}
    assert all(abs(small[k] - large[k]) < 1e-3 for k in small)


def test_fits_of_any_size_are_those_of_one_model(spark, monkeypatch):
    monkeypatch.setattr(crossval, "MAX_TRAINING_ROWS", 10)
    rng = np.random.default_rng(5)
    data = [(f"S{i}", i % 2, (i // 2) % 4, *(float(v) for v in rng.normal(i % 2 * 0.5, 1, 4) * [1, 9, 1, 1] + [0, 500, 0, 0]), float(i // 2 % 4 == 3)) for i in range(120)]
    names = ["a", "b", "c", "d", "flat"]
    df = spark.createDataFrame(data, "subject_id string, label int, fold int, a double, b double, c double, d double, flat double")
    x, y, fold = np.array([r[3:] for r in data]), np.array([r[1] for r in data]), np.array([r[2] for r in data])
    for recipe in (Recipe(c=0.1), Recipe(k=2), Recipe(components=2), Recipe(c=5.0, k=4, components=1, keep=1)):
        got = {r.subject_id: r.y_score for r in crossval.cross_validate(df, names, recipe).collect()}
        for k in range(4):
            want = logistic.Model(x[fold != k], y[fold != k], recipe).score(x[fold == k])
            assert np.allclose([got[f"S{i}"] for i in np.flatnonzero(fold == k)], want, atol=1e-7), recipe
    assert crossval.nested_cross_validate(df, names, [Recipe(c=0.01), Recipe(k=2)])[0].count() == 120


def test_nested(spark):
    df = cv_frame(spark, 3, 20)
    rows = df.union(df.withColumn("feat_b", F.col("feat_b") + 1))
    grid = [Recipe(c=0.01), Recipe(c=1.0, k=1), Recipe(c=1.0, components=1)]
    predictions, chosen = crossval.nested_cross_validate(rows, ["feat_a", "feat_b"], grid)
    got = predictions.collect()
    assert len(got) == 40 and {r.n_rows for r in got} == {2} and np.mean([r.y_pred == r.label for r in got]) > 0.85
    assert chosen.count() == 5 and crossval.selection_stability(chosen, ["c", "k"]).agg(F.sum("count")).first()[0] == 5
    with pytest.raises(ValueError, match="three folds"):
        crossval.nested_cross_validate(rows.where("fold < 2"), ["feat_a"], grid)


def test_artifact(spark, tmp_path):
    df = cv_frame(spark, 2)
    model = logistic.fit_large(df, ["feat_b", "feat_a"])
    about = artifact.card(spark, "m", ["feat_b", "feat_a"], source="frame", target="case", subjects=100, scores={"auc": 0.8})
    folder = f"file://{tmp_path}/m"
    with pytest.raises(FileNotFoundError, match="card, parameters"):
        artifact.load(spark, folder)
    artifact.save(spark, folder, model, about)
    again, read = artifact.load(spark, folder)
    same = ("name", "inputs", "source", "target", "subjects", "decision", "scores", "settings", "format")
    assert again == model and all(read[c] == about[c] for c in same) and abs(read.made_at - about.made_at).total_seconds() < 1
    assert artifact.apply_model(df, again, read).where("y_pred is not null").count() == 100
    assert artifact.arranged(about.inputs, ["feat_a", "x", "feat_b"]) == ["feat_b", "feat_a"]
    with pytest.raises(ValueError, match="feat_b"):
        artifact.apply_model(df.drop("feat_b"), again, read)
    with pytest.raises(ValueError, match="12 inputs .* c9$"):
        artifact.arranged([f"c{i}" for i in range(12)], ["x"])
    artifact.save(spark, folder, model, artifact.card(spark, "m", ["feat_a"], format="0.1"))
    with pytest.raises(ValueError, match="0.1"):
        artifact.load(spark, folder)
    for wrong in ({"inputs": []}, {"inputs": ["a"], "decision": 1.0}, {"inputs": ["a"], "decision": None}):
        with pytest.raises(ValueError, match="must"):
            artifact.card(spark, "m", **wrong)
    assert artifact.feature_set(df.withColumn("age", F.lit(1)), "age_only", "subject_id").columns == ["subject_id", "age"]
    with pytest.raises(ValueError, match="no feature set"):
        artifact.feature_set(df, "unknown")


def test_a_volume_of_real_size(spark):
    """176 x 208 x 176 voxels in one row: every block and every value as NumPy has them."""
    n = 176 * 208 * 176
    big = spark.range(1).select("id", F.lit([176, 208, 176]).alias("shape"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pmod(i.cast("bigint") * 7919, F.lit(4)).cast("int")).alias("seg"))
    seg = (np.arange(n) * 7919 % 4).reshape(176, 208, 176)
    found = {(r.i, r.j, r.k): (r.csf, r.voxels) for r in features.block_counts(big, "id", n=4).collect()}
    part = seg[44:88, 156:208, 0:44]
    assert len(found) == 64 and found[1, 3, 0] == ((part == 1).sum(), part.size)
    sums = big.select(voxels.preprocess(F.col("seg"), "zscore").alias("z")).select(F.size("z"), F.aggregate("z", F.lit(0.0), lambda a, v: a + v)).first()
    v = np.clip(seg.ravel().astype(float), *np.percentile(seg, [1, 99]))
    assert sums[0] == n and sums[1] == pytest.approx(((v - v[v > 0].mean()) / v[v > 0].std()).sum(), rel=1e-9)


def test_volume_files(spark, tmp_path):
    a = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    for shape, name in (([2, 3, 4, 1], "a"), ([2, 3, 4], "b")):
        header, image = volume_files.encode(shape, a)
        (tmp_path / f"{name}.hdr").write_bytes(header)
        (tmp_path / f"{name}.img").write_bytes(image)
    (tmp_path / "c.hdr").write_bytes(header)
    got = volume_files.read_volumes(spark, str(tmp_path)).collect()
    assert len(got) == 2 and all(r.shape == [2, 3, 4] and r.data == a.ravel().tolist() for r in got)
    (tmp_path / "seg").mkdir()
    for part, content in zip(("hdr", "img"), volume_files.encode([1, 1, 4], np.array([0.0, 1.9, 2.0, -0.5]))):
        (tmp_path / "seg" / f"s.{part}").write_bytes(content)
    assert volume_files.read_segmentations(spark, str(tmp_path / "seg")).first().data == [0, 1, 2, 0]
    with pytest.raises(ValueError, match="dimensions"):
        volume_files.decode(*volume_files.encode([2, 3, 2, 2], a))
    with pytest.raises(ValueError, match="header"):
        volume_files.decode(b"x", b"")
    path = f"{tmp_path}/cache_n3"
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert volume_files.cached(spark, path, make).count() == volume_files.cached(spark, path, make).count() == 3 and len(made) == 1


def test_near_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert features.near_constant(df, ["a", "b"]) == ["a"]
