"""Registered queries over voxel arrays: each row of `embeddings` read as a volume of 4 x 4 x 4 in C order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators import features, voxels
from cohortspark.sources import artifact
from cohortspark.sources.tables import table

N_BLOCKS = 2


def volumes(spark: SparkSession, sf: str) -> DataFrame:
    data = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("subject_id"), (F.col("label") >= 5).cast("int").alias("label"), data.alias("data"), F.lit([4, 4, 4]).alias("shape"))


def _labelled(data: Column, low: float, high: float) -> Column:
    return F.transform(data, lambda v: F.when(v <= 0, 0).when(v < low, 1).when(v < high, 2).otherwise(3))


def segmentations(spark: SparkSession, sf: str) -> DataFrame:
    v = volumes(spark, sf)
    return v.select("subject_id", "label", "shape", _labelled(F.col("data"), 0.0625, 0.125).alias("seg"), _labelled(F.col("data"), 0.078125, 0.15625).alias("reference"))


def _cells(df: DataFrame, data: Column, *keys: str) -> DataFrame:
    return df.select("subject_id", *keys, F.posexplode(data).alias("i", "value")).withColumn("value", F.round("value", 6))


def _mapped(function):
    return lambda spark, sf: _cells(volumes(spark, sf), function(F.col("data")))


def vox_plane(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(volumes(spark, sf), voxels.plane(F.col("data"), F.col("shape"), 1, 2))


def vox_central_planes(spark: SparkSession, sf: str) -> DataFrame:
    v = volumes(spark, sf)
    rows = v.select("subject_id", F.inline(voxels.central_planes(F.col("data"), F.col("shape"), 2, 3)))
    return _cells(rows, F.col("plane"), "position")


def vox_samples(spark: SparkSession, sf: str) -> DataFrame:
    v = volumes(spark, sf)
    rows = v.select("subject_id", F.inline(voxels.subject_samples(F.col("data"), F.col("shape"), 1, 3, 1, "adjacent")))
    rows = rows.select("subject_id", "position", F.posexplode("channels").alias("channel", "plane"))
    return _cells(rows, F.col("plane"), "position", "channel")


def vox_standardized(spark: SparkSession, sf: str) -> DataFrame:
    v = volumes(spark, sf)
    channels = voxels.standardize_channels(voxels.axis_sample(F.col("data"), F.col("shape"), F.lit(1), 0, "replicate"))
    rows = v.select("subject_id", F.posexplode(channels).alias("channel", "plane"))
    return _cells(rows, F.col("plane"), "channel")


def vox_padded(spark: SparkSession, sf: str) -> DataFrame:
    v = volumes(spark, sf)
    square = voxels.pad_to_square(voxels.plane(F.col("data"), F.col("shape"), 0, 1), voxels.plane_shape(F.col("shape"), 0), F.lit(6))
    return _cells(v, square)


def vox_triplanar(spark: SparkSession, sf: str) -> DataFrame:
    v = volumes(spark, sf)
    rows = v.select("subject_id", F.posexplode(voxels.triplanar_sample(F.col("data"), F.col("shape"), -1)).alias("axis", "plane"))
    return _cells(rows, F.col("plane"), "axis")


def tissue_features(spark: SparkSession, sf: str) -> DataFrame:
    found = features.tissue_features(segmentations(spark, sf))
    return found.select("subject_id", *[F.round(c, 6).alias(c) if c.endswith(("fraction", "ratio")) else F.col(c) for c in features.TISSUE_FEATURES])


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return features.block_counts(segmentations(spark, sf), "subject_id", n=N_BLOCKS)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6))


def regional_fractions(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(features.regional_fractions(_blocks(spark, sf), "subject_id"))


def block_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(features.block_occupancy(_blocks(spark, sf), "subject_id"))


def asymmetry(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(features.asymmetry(features.regional_fractions(_blocks(spark, sf), "subject_id"), "subject_id", N_BLOCKS))


def regional_vector(spark: SparkSession, sf: str) -> DataFrame:
    """Long form again, with the parsed block index of each name."""
    found = features.regional_vector(_blocks(spark, sf), "subject_id", N_BLOCKS)
    long = found.select("subject_id", F.explode("features").alias("name", "value"))
    return _rounded(long.select("subject_id", "name", "value", features.block_index(F.col("name")).alias("at")).select("subject_id", "name", "value", "at.i", "at.j", "at.k"))


def dice(spark: SparkSession, sf: str) -> DataFrame:
    found = features.segmentation_agreement(segmentations(spark, sf), "seg", "reference")
    return found.select("subject_id", *[F.round(f"dice_{t}", 6).alias(f"dice_{t}") for t in features.BRAIN])


def vox_foreground(spark: SparkSession, sf: str) -> DataFrame:
    v = volumes(spark, sf)
    return v.select("subject_id", F.posexplode(voxels.foreground(F.col("data"), 0.05)).alias("i", "inside"))


def vox_triplanar_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """One sample per offset: how often its planes hold something, after the shape lost its last size of 1."""
    v = volumes(spark, sf).withColumn("shape", voxels.require_volume(F.concat("shape", F.array(F.lit(1)))))
    samples = F.array(*[F.struct(F.lit(o).alias("position"), voxels.triplanar_sample(F.col("data"), F.col("shape"), o).alias("planes")) for o in voxels.triplanar_offsets(3, 1)])
    rows = v.select("subject_id", F.inline(samples))
    return rows.select("subject_id", "position", F.size(F.filter(F.flatten("planes"), lambda x: x > 0)).alias("n_positive"))


def block_centres(spark: SparkSession, sf: str) -> DataFrame:
    """The voxel in the middle of each block, and its label."""
    centres = [(i, j, k, *features.block_centre((4, 4, 4), N_BLOCKS, (i, j, k))) for i in range(N_BLOCKS) for j in range(N_BLOCKS) for k in range(N_BLOCKS)]
    at = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("ijkxyz", c)]) for c in centres])
    rows = segmentations(spark, sf).select("subject_id", "seg", F.inline(at))
    return rows.select("subject_id", "i", "j", "k", F.get("seg", F.col("x") * 16 + F.col("y") * 4 + F.col("z")).alias("label"))


def tissue_set(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of a named feature set, in its order."""
    found = artifact.feature_set(features.tissue_features(segmentations(spark, sf)), "tissue_only", "subject_id")
    return found.select("subject_id", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


QUERIES = {
    "vox_foreground": vox_foreground, "vox_triplanar_offsets": vox_triplanar_offsets, "block_centres": block_centres, "tissue_set": tissue_set,
    "vox_clip": _mapped(voxels.clip_percentile), "vox_minmax": _mapped(voxels.minmax), "vox_zscore": _mapped(voxels.zscore),
    "vox_preprocess": _mapped(lambda d: voxels.preprocess(d, "zscore")), "vox_plane": vox_plane, "vox_central_planes": vox_central_planes,
    "vox_samples": vox_samples, "vox_standardized": vox_standardized, "vox_padded": vox_padded, "vox_triplanar": vox_triplanar,
    "tissue_features": tissue_features, "regional_fractions": regional_fractions, "block_occupancy": block_occupancy, "asymmetry": asymmetry,
    "regional_vector": regional_vector, "dice": dice,
}

_V = "WITH v AS (SELECT vec_id AS subject_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS n, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), x AS (SELECT *, n // 16 AS a, (n // 4) % 4 AS b, n % 4 AS c FROM v)"
_CLIP = ", q AS (SELECT subject_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM v GROUP BY subject_id), clipped AS (SELECT subject_id, n, greatest(lo, least(hi, v)) AS v FROM v JOIN q USING (subject_id))"
_Z = "SELECT subject_id, n AS i, round(CASE WHEN sd > 0 THEN (v - m) / sd ELSE 0 END, 6) AS value FROM {0} JOIN (SELECT subject_id, avg(v) FILTER (v > 0) AS m, stddev_pop(v) FILTER (v > 0) AS sd FROM {0} GROUP BY subject_id) s USING (subject_id)"
_SEG = ", s AS (SELECT *, CASE WHEN v <= 0 THEN 0 WHEN v < 0.0625 THEN 1 WHEN v < 0.125 THEN 2 ELSE 3 END AS seg, CASE WHEN v <= 0 THEN 0 WHEN v < 0.078125 THEN 1 WHEN v < 0.15625 THEN 2 ELSE 3 END AS reference FROM x)"
_BLOCKS = ", g AS (SELECT subject_id, a // 2 AS i, b // 2 AS j, c // 2 AS k, count(*) FILTER (seg = 1) AS csf, count(*) FILTER (seg = 2) AS grey_matter, count(*) FILTER (seg = 3) AS white_matter, count(*) FILTER (seg > 0) AS brain, count(*) AS voxels FROM s GROUP BY ALL)"
_FRACTIONS = ", f AS (" + " UNION ALL ".join(f"SELECT subject_id, '{t}' AS tissue, i, j, k, coalesce({t} / nullif(brain, 0), 0) AS value FROM g" for t in features.BRAIN) + ")"
_ASYM = ", y AS (SELECT l.subject_id, l.tissue, l.i, l.j, l.k, l.value - r.value AS value FROM f l JOIN f r ON l.subject_id = r.subject_id AND l.tissue = r.tissue AND l.j = r.j AND l.k = r.k AND r.i = 1 - l.i WHERE l.i < 1)"
_NAMED = "'_b' || i || '_' || j || '_' || k"
_TRI = " UNION ALL ".join(f"SELECT subject_id, {axis} AS axis, {r} * 4 + {c} AS i, round(v, 6) AS value FROM x WHERE {at} = 1" for axis, at, r, c in ((0, "a", "b", "c"), (1, "b", "a", "c"), (2, "c", "a", "b")))
_SHARE = "round(coalesce({0} / nullif({1}, 0), 0), 6)"
ORACLES = {
    "vox_foreground": _V + "SELECT subject_id, n AS i, v > 0.05 AS inside FROM v",
    "vox_triplanar_offsets": _V + " SELECT subject_id, position, CAST(sum(hit) AS INTEGER) AS n_positive FROM (SELECT subject_id, position, (CASE WHEN a = 2 + position THEN 1 ELSE 0 END + CASE WHEN b = 2 + position THEN 1 ELSE 0 END + CASE WHEN c = 2 + position THEN 1 ELSE 0 END) * CASE WHEN v > 0 THEN 1 ELSE 0 END AS hit FROM x, (SELECT unnest([-1, 0, 1]) AS position) p) h GROUP BY ALL",
    "block_centres": _V + _SEG + "SELECT subject_id, a // 2 AS i, b // 2 AS j, c // 2 AS k, seg AS label FROM s WHERE a % 2 = 1 AND b % 2 = 1 AND c % 2 = 1",
    "tissue_set": _V + _SEG + ", t AS (SELECT subject_id, count(*) FILTER (seg = 1) AS c, count(*) FILTER (seg = 2) AS g, count(*) FILTER (seg = 3) AS w FROM s GROUP BY subject_id) SELECT subject_id, " + ", ".join(
        _SHARE.format(*parts) + f" AS {name}" for name, parts in (("grey_matter_fraction", ("g", "c + g + w")), ("csf_fraction", ("c", "c + g + w")), ("white_matter_fraction", ("w", "c + g + w")), ("gm_csf_ratio", ("g", "c")), ("gm_wm_ratio", ("g", "w")), ("brain_csf_ratio", ("(g + w)", "c")))
    ) + " FROM t",
    "vox_clip": _V + _CLIP + "SELECT subject_id, n AS i, round(v, 6) AS value FROM clipped",
    "vox_minmax": _V + "SELECT subject_id, n AS i, round((v - lo) / (hi - lo), 6) AS value FROM v JOIN (SELECT subject_id, min(v) AS lo, max(v) AS hi FROM v GROUP BY subject_id) USING (subject_id)",
    "vox_zscore": _V + _Z.format("v"),
    "vox_preprocess": _V + _CLIP + _Z.format("clipped"),
    "vox_plane": _V + "SELECT subject_id, a * 4 + c AS i, round(v, 6) AS value FROM x WHERE b = 2",
    "vox_central_planes": _V + "SELECT subject_id, c AS position, a * 4 + b AS i, round(v, 6) AS value FROM x WHERE c BETWEEN 1 AND 3",
    "vox_samples": _V + "SELECT subject_id, p.position, ch.channel, a * 4 + c AS i, round(v, 6) AS value FROM x, (SELECT unnest([1, 2, 3]) AS position) p, (SELECT unnest([0, 1, 2]) AS channel) ch WHERE b = greatest(0, least(3, p.position + ch.channel - 1))",
    "vox_standardized": _V + "SELECT subject_id, ch.channel, b * 4 + c AS i, round((v - [0.485, 0.456, 0.406][ch.channel + 1]) / [0.229, 0.224, 0.225][ch.channel + 1], 6) AS value FROM x, (SELECT unnest([0, 1, 2]) AS channel) ch WHERE a = 1",
    "vox_padded": _V + "SELECT e.subject_id, e.p AS i, round(coalesce(x.v, 0), 6) AS value FROM (SELECT DISTINCT subject_id, p FROM v, (SELECT unnest(range(0, 36)) AS p) q) e LEFT JOIN x ON x.subject_id = e.subject_id AND x.a = 1 AND x.b = e.p // 6 - 1 AND x.c = e.p % 6 - 1",
    "vox_triplanar": _V + _TRI,
    "tissue_features": _V + _SEG + """, t AS (SELECT subject_id, count(*) FILTER (seg = 0) AS b, count(*) FILTER (seg = 1) AS c, count(*) FILTER (seg = 2) AS g, count(*) FILTER (seg = 3) AS w FROM s GROUP BY subject_id)
        SELECT subject_id, b AS background_voxels, c AS csf_voxels, g AS grey_matter_voxels, w AS white_matter_voxels, c + g + w AS intracranial_voxels,
        round(coalesce(c / nullif(c + g + w, 0), 0), 6) AS csf_fraction, round(coalesce(g / nullif(c + g + w, 0), 0), 6) AS grey_matter_fraction, round(coalesce(w / nullif(c + g + w, 0), 0), 6) AS white_matter_fraction,
        round(coalesce(g / nullif(c, 0), 0), 6) AS gm_csf_ratio, round(coalesce(g / nullif(w, 0), 0), 6) AS gm_wm_ratio, round(coalesce((g + w) / nullif(c, 0), 0), 6) AS brain_csf_ratio FROM t""",
    "regional_fractions": _V + _SEG + _BLOCKS + _FRACTIONS + "SELECT subject_id, tissue, i, j, k, round(value, 6) AS value FROM f",
    "block_occupancy": _V + _SEG + _BLOCKS + "SELECT subject_id, i, j, k, round(brain / voxels, 6) AS value FROM g",
    "asymmetry": _V + _SEG + _BLOCKS + _FRACTIONS + _ASYM + "SELECT subject_id, tissue, i, j, k, round(value, 6) AS value FROM y",
    "regional_vector": _V + _SEG + _BLOCKS + _FRACTIONS + _ASYM + f"""SELECT subject_id, tissue || {_NAMED} AS name, round(value, 6) AS value, i, j, k FROM f UNION ALL
        SELECT subject_id, 'asym_' || tissue || {_NAMED}, round(value, 6), i, j, k FROM y UNION ALL SELECT subject_id, 'occupancy' || {_NAMED}, round(brain / voxels, 6), i, j, k FROM g""",
    "dice": _V + _SEG + "SELECT subject_id, " + ", ".join(f"round(coalesce(2 * count(*) FILTER (seg = {c} AND reference = {c}) / nullif(count(*) FILTER (seg = {c}) + count(*) FILTER (reference = {c}), 0), 1), 6) AS dice_{t}" for t, c in features.TISSUES.items() if c) + " FROM s GROUP BY subject_id",
}
