"""The SQL that the cohort queries are compared with."""

from __future__ import annotations

from cohortspark.operators.metrics import poisson_limits

_ASCII = "translate({}, '０１２３４５６７８９', '0123456789')"


def _number(column: str, pattern: str) -> str:
    return f"NULLIF(regexp_extract({_ASCII.format(column)}, '{pattern}', 1), '')"


def subject(*columns: str) -> str:
    found = ", ".join(_number(c, "(?i)oas[^0-9]*0*1[^0-9]+([0-9]+)") for c in columns)
    return f"'OAS1_' || lpad(CAST(CAST(coalesce({found}) AS BIGINT) AS VARCHAR), 8, '0')"


_SESSION = f"'MR' || CAST(CAST(coalesce({_number('session_id', '(?i)mr[^0-9]*([0-9]+)')}, {_number('raw_id', '(?i)oas[^0-9]*0*1[^0-9]+[0-9]+[^0-9]+([0-9]+)')}) AS BIGINT) AS VARCHAR)"

SESSIONS = f"""
sheet AS (SELECT *, {subject('subject_id', 'raw_id')} AS s, {_SESSION} AS m FROM subject_records),
sessions AS (
  SELECT s AS subject_id, m AS session_id, s || '_' || m AS raw_id, sex, age,
    CASE WHEN isnan(education) THEN NULL ELSE education END AS education, CASE WHEN isnan(ses) THEN NULL ELSE ses END AS ses,
    CASE WHEN isnan(mmse) THEN NULL ELSE mmse END AS mmse, cdr, CASE WHEN cdr = 0 THEN 0 ELSE 1 END AS label, etiv, CASE WHEN isnan(nwbv) THEN NULL ELSE nwbv END AS nwbv, CASE WHEN isnan(asf) THEN NULL ELSE asf END AS asf,
    coalesce(cdr >= 0.5 OR (cdr = 0 AND age >= 60), FALSE) AS age_matched_cohort
  FROM sheet WHERE cdr IS NOT NULL AND NOT isnan(cdr) AND (cdr = 0 OR cdr >= 0.5))"""

LABELLED = "labelled AS (SELECT subject_id, max(label) AS label, max(age) AS age, max(cdr) AS cdr FROM sessions WHERE age_matched_cohort GROUP BY subject_id)"
FOLDS = """known AS (SELECT subject_id, label FROM labelled WHERE subject_id IS NOT NULL AND label IS NOT NULL),
before AS (SELECT label, coalesce(sum(count(*)) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM known GROUP BY label),
folds AS (SELECT k.subject_id, k.label, CAST((row_number() OVER (PARTITION BY k.label ORDER BY md5('42|' || k.subject_id), k.subject_id) - 1 + b.earlier) % 5 AS INTEGER) AS fold FROM known k JOIN before b USING (label))"""
SLICES = f"""slices AS (SELECT DISTINCT {subject('subject_id')} AS subject_id, label, fold, slice_position, y_score FROM slice_scores WHERE {subject('subject_id')} IS NOT NULL)"""
CLEAN = """bad AS (SELECT subject_id FROM slices GROUP BY subject_id HAVING count(DISTINCT label) > 1 OR count(DISTINCT fold) > 1),
clean AS (SELECT *, CASE WHEN isnan(y_score) THEN NULL ELSE y_score END AS v FROM slices WHERE subject_id NOT IN (SELECT subject_id FROM bad))"""


def _aggregated(function: str, name: str = "agg") -> str:
    return f"""{name} AS (SELECT subject_id, min(label) AS label, {function}(v) AS score, count(v) AS n_slices, min(fold) AS fold FROM clean GROUP BY subject_id HAVING count(v) > 0)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_AGG_SELECT = "SELECT subject_id, label, round(score, 9) AS y_score, n_slices, fold, CAST(score >= 0.5 AS INTEGER) AS y_pred FROM agg"
_PREDICTIONS = _with(SLICES, CLEAN, _aggregated("max"), "preds AS (SELECT subject_id, label AS y_true, CAST(score >= 0.5 AS INTEGER) AS y_pred, round(score, 9) AS y_score FROM agg)")
_CELLS = "count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp"
_IMAGES = r"""images AS (
  SELECT regexp_extract(image_path, '(?:^|/)disc[^/]*/(OAS1_[^/]+)/', 1) AS raw_id, count(DISTINCT image_path) AS n_images, min(image_path) AS image_path
  FROM session_files
  WHERE size_bytes > 0 AND regexp_extract(image_path, '(?:^|/)disc[^/]*/(OAS1_[^/]+)/(?:[^/]+/)*(OAS1_[^/]+?)_mpr_n[^/]*_anon_111_t88_masked_gfc\.img$', 1) <> ''
    AND regexp_extract(image_path, '(?:^|/)disc[^/]*/(OAS1_[^/]+)/', 1) = regexp_extract(image_path, '/([^/]+?)_mpr_n[^/]*_anon_111_t88_masked_gfc\.img$', 1)
  GROUP BY 1)"""
_AVAILABLE = """distinct_sessions AS (SELECT DISTINCT subject_id, raw_id, label, age, sex, cdr, nwbv, etiv, asf, mmse, education FROM sessions),
available AS (SELECT d.*, coalesce(i.image_path, '') AS image_path, i.image_path IS NOT NULL AS image_available FROM distinct_sessions d LEFT JOIN (SELECT * FROM images WHERE n_images = 1) i USING (raw_id))"""
_STATES = """distinct_sessions AS (SELECT DISTINCT subject_id, raw_id, label, age, sex, cdr, nwbv, etiv, asf, mmse, education FROM sessions),
states AS (SELECT d.*, coalesce(i.n_images, 0) AS n_images, CASE WHEN i.n_images = 1 THEN i.image_path ELSE '' END AS image_path FROM distinct_sessions d LEFT JOIN images i USING (raw_id))"""
_FEATURES = ["age", "education", "mmse", "etiv", "asf"]


def _long(template: str, values: list) -> str:
    return " UNION ALL ".join(template.format(*(v if isinstance(v, tuple) else (v,))) for v in values)


_MUST = ("subject_id", "session_id", "raw_id", "sex", "age", "cdr", "label", "etiv", "nwbv", "asf")
_PAIRS = [(a, b) for i, a in enumerate(_FEATURES) for b in _FEATURES[i + 1 :]]
_SHUFFLE = """take AS (SELECT subject_id, {g} AS g, fold, row_number() OVER (PARTITION BY {g} ORDER BY md5('42a|' || subject_id)) AS n FROM folds),
give AS (SELECT {g} AS g, label, row_number() OVER (PARTITION BY {g} ORDER BY md5('42b|' || subject_id)) AS n FROM folds)
SELECT t.subject_id, v.label, t.fold FROM take t JOIN give v USING (g, n)"""

_WEIGHT = " + ".join(f"CAST(substr(h, 8 * j + 1, 8) >= '{limit}' AS INTEGER)" for limit in poisson_limits())
_BOUNDS = "round(quantile_cont(value, 0.025), 9) AS lower, round(quantile_cont(value, 0.975), 9) AS upper, count(*) AS n_eff"
_TWO = _with(SLICES, CLEAN, _aggregated("avg", "a"), _aggregated("max", "m"), "preds AS (SELECT subject_id, m.label AS y_true, CAST(a.score >= 0.5 AS INTEGER) AS pa, CAST(m.score >= 0.5 AS INTEGER) AS pb, round(a.score, 9) AS sa, round(m.score, 9) AS sb FROM a JOIN m USING (subject_id))")
_DRAWN = f""", h AS (SELECT p.*, block, md5('42|' || subject_id || '|' || block) AS h FROM preds p, range(500) AS r(block)),
w AS (SELECT * EXCLUDE (h), block * 4 + j AS b, {_WEIGHT} AS w FROM h, range(4) AS d(j))"""


def _balanced(pred: str, w: str) -> str:
    hit = lambda v: f"sum({w}) FILTER (y_true = {v} AND {pred} = {v}) / sum({w}) FILTER (y_true = {v})"
    return f"(coalesce({hit(1)}, 0) + coalesce({hit(0)}, 0)) / 2"


def _area(score: str, name: str) -> str:
    """Of each replicate the area under the curve; replicate -1 is the sample itself."""
    return f""", {name}_s AS (SELECT b, {score} AS s, sum(w) FILTER (y_true = 1) AS p, sum(w) FILTER (y_true = 0) AS n FROM all_w GROUP BY ALL),
{name}_l AS (SELECT b, coalesce(p, 0) AS p, coalesce(n, 0) AS n, coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY b ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM {name}_s),
{name} AS (SELECT b, sum(p * (2 * l + n)) / (2 * sum(p) * sum(n)) AS value FROM {name}_l GROUP BY b HAVING sum(p) > 0 AND sum(n) > 0)"""


_ALL = ", all_w AS (SELECT * EXCLUDE (block, j) FROM w UNION ALL BY NAME SELECT *, -1 AS b, 1 AS w FROM preds)"
_POINT = "SELECT round((SELECT value FROM v WHERE b = -1), 9) AS point, " + _BOUNDS + " FROM v WHERE b >= 0"
_BOTH_CLASSES = "HAVING sum(w) FILTER (y_true = 1) > 0 AND sum(w) FILTER (y_true = 0) > 0"

ORACLES = {
    "bootstrap_ba": _PREDICTIONS + _DRAWN + _ALL + f", v AS (SELECT b, {_balanced('y_pred', 'w')} AS value FROM all_w GROUP BY b {_BOTH_CLASSES}), f AS ({_POINT}) SELECT *, printf('%.3f [%.3f, %.3f]', point, lower, upper) AS text, lower > 0.5 AS beats_chance FROM f",
    "bootstrap_diff": _TWO + _DRAWN + _ALL + f", v AS (SELECT b, {_balanced('pb', 'w')} - {_balanced('pa', 'w')} AS value FROM all_w GROUP BY b {_BOTH_CLASSES}) " + _POINT,
    "bootstrap_auc": _PREDICTIONS + _DRAWN + _ALL + _area("y_score", "v") + " " + _POINT,
    "bootstrap_auc_diff": _TWO + _DRAWN + _ALL + _area("sa", "x") + _area("sb", "y") + ", v AS (SELECT b, y.value - x.value AS value FROM x JOIN y USING (b)) " + _POINT,
    "fold_masks": _with(SESSIONS, LABELLED, FOLDS) + "SELECT CAST(k AS INTEGER) AS fold, CASE WHEN f.fold = k THEN 'test' ELSE 'train' END AS side, count(*) AS n, sum(label) AS n_demented FROM folds f, range(5) AS r(k) GROUP BY ALL",
    "ranked_sites": f"SELECT site, round(avg(age), 6) AS mean_age, count(DISTINCT {subject('subject_id', 'raw_id')}) AS n_subjects, count(DISTINCT batch_day) AS n_days FROM subject_records GROUP BY site",
    "top_sessions": _with(_IMAGES) + "SELECT raw_id FROM images ORDER BY raw_id LIMIT 10",
    "label_pairs": _with(SESSIONS, SLICES) + "SELECT subject_id, label FROM sessions UNION SELECT subject_id, label FROM slices",
    "slice_subjects_without_sessions": _with(SESSIONS, SLICES) + "SELECT subject_id FROM slices EXCEPT SELECT subject_id FROM sessions",
    "aligned_predictions": _with(SLICES, CLEAN, _aggregated("avg", "a"), _aggregated("max", "b")) + "SELECT b.label AS y_true, count(*) AS n, count(*) FILTER ((a.score >= 0.5) = (b.score >= 0.5)) AS n_agree FROM a JOIN b USING (subject_id) GROUP BY b.label",
    "manifest_build": _with(SESSIONS) + "SELECT * FROM sessions",
    "manifest_violations": _with(SESSIONS) + "SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER ({c} IS NULL{f' OR isnan({c})' if c in ('cdr', 'nwbv', 'asf') else ''}) AS {c}_missing" for c in _MUST) + ", count(*) FILTER (label NOT IN (0, 1)) AS label_invalid FROM sessions",
    "cohort_filter": _with(SESSIONS) + "SELECT label, sex, count(*) AS n, count(DISTINCT subject_id) AS n_subjects FROM sessions WHERE age_matched_cohort GROUP BY ALL",
    "fold_assign": _with(SESSIONS, LABELLED, FOLDS) + "SELECT * FROM folds",
    "fold_summary": _with(SESSIONS, LABELLED, FOLDS) + """SELECT f.fold, count(DISTINCT s.subject_id) AS n_subjects, count(*) AS n_rows, count(*) FILTER (f.label = 0) AS n_cn, count(*) FILTER (f.label = 1) AS n_demented,
        round_even(100.0 * sum(f.label) / count(*), 1) AS pct_demented, round_even(avg(s.age), 1) AS mean_age FROM sessions s JOIN folds f USING (subject_id) WHERE s.age_matched_cohort GROUP BY f.fold""",
    "label_conflicts": _with(SESSIONS) + "SELECT subject_id, count(DISTINCT label) AS n_values FROM sessions WHERE subject_id IS NOT NULL GROUP BY subject_id HAVING count(DISTINCT label) > 1",
    "slice_leakage": _with(SLICES) + "SELECT subject_id, count(DISTINCT fold) AS n_values FROM slices GROUP BY subject_id HAVING count(DISTINCT fold) > 1",
    "slice_exclusions": _with(SLICES) + """, per AS (SELECT subject_id, count(DISTINCT label) > 1 AS label_conflict, count(DISTINCT fold) > 1 AS fold_conflict, count(*) AS n_slices FROM slices GROUP BY subject_id)
        SELECT label_conflict, fold_conflict, count(*) AS n_subjects, sum(n_slices) AS n_slices FROM per WHERE label_conflict OR fold_conflict GROUP BY ALL""",
    "agg_mean": _with(SLICES, CLEAN, _aggregated("avg")) + _AGG_SELECT,
    "agg_median": _with(SLICES, CLEAN, _aggregated("median")) + _AGG_SELECT,
    "agg_max": _with(SLICES, CLEAN, _aggregated("max")) + _AGG_SELECT,
    "slice_agreement": _with(SLICES, CLEAN) + """, per AS (SELECT subject_id, count(*) AS n_slices, count(*) FILTER (v >= 0.5) AS n_positive, stddev_pop(v) AS sd FROM clean WHERE v IS NOT NULL GROUP BY subject_id)
        SELECT subject_id, n_slices, n_positive, CASE WHEN 2 * n_positive > n_slices THEN 1 ELSE 0 END AS majority,
        round(CASE WHEN 2 * n_positive > n_slices THEN n_positive ELSE n_slices - n_positive END / n_slices, 6) AS agreement, round(sd, 6) AS score_std FROM per""",
    "confusion": _PREDICTIONS + f"SELECT {_CELLS} FROM preds",
    "report": _PREDICTIONS + f""", c AS (SELECT {_CELLS} FROM preds)
        SELECT tn + fp + fn + tp AS n, tp + fn AS n_positive, round((tn + tp) / (tn + fp + fn + tp), 9) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy,
        round(tp / (tp + fn), 9) AS sensitivity, round(tn / (tn + fp), 9) AS specificity, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""",
    "auc": _PREDICTIONS + """, r AS (SELECT y_true, rank() OVER (ORDER BY y_score) + (count(*) OVER (PARTITION BY y_score) - 1) / 2.0 AS rk FROM preds)
        SELECT round((sum(rk) FILTER (y_true = 1) - count(*) FILTER (y_true = 1) * (count(*) FILTER (y_true = 1) + 1) / 2.0) / (count(*) FILTER (y_true = 1) * count(*) FILTER (y_true = 0)), 9) AS auc FROM r""",
    "roc_points": _PREDICTIONS + """, g AS (SELECT y_score, count(*) FILTER (y_true = 1) AS p, count(*) FILTER (y_true = 0) AS n FROM preds GROUP BY y_score)
        SELECT y_score AS threshold, round(sum(n) OVER (ORDER BY y_score DESC) / (SELECT sum(n) FROM g), 9) AS fpr, round(sum(p) OVER (ORDER BY y_score DESC) / (SELECT sum(p) FROM g), 9) AS tpr FROM g""",
    "ambiguous_images": _with(_IMAGES) + "SELECT * FROM images WHERE n_images > 1",
    "availability": _with(SESSIONS, _IMAGES, _AVAILABLE) + "SELECT DISTINCT raw_id, label, age, image_path, image_available FROM available",
    "availability_by_fold": _with(SESSIONS, LABELLED, FOLDS, _IMAGES, _AVAILABLE) + """SELECT f.fold, count(*) AS n, sum(f.label) AS n_demented, count(*) FILTER (a.image_available) AS n_available, count(*) - sum(f.label) AS n_cn
        FROM available a JOIN folds f USING (subject_id) GROUP BY f.fold""",
    "missing_vs_present": _with(SESSIONS, _IMAGES, _AVAILABLE) + "SELECT round(avg(age) FILTER (image_available), 6) AS mean_present, round(avg(age) FILTER (NOT image_available), 6) AS mean_missing FROM available",
    "image_states": _with(SESSIONS, _IMAGES, _STATES) + "SELECT DISTINCT raw_id, label, age, image_path, n_images >= 1 AS image_available, n_images > 1 AS image_ambiguous FROM states",
    "image_states_by_fold": _with(SESSIONS, LABELLED, FOLDS, _IMAGES, _STATES) + """SELECT f.fold, count(*) AS n, sum(f.label) AS n_demented, count(*) FILTER (s.n_images = 1) AS n_one, count(*) FILTER (s.n_images > 1) AS n_ambiguous,
        count(*) FILTER (s.n_images = 0) AS n_none, count(*) - sum(f.label) AS n_cn FROM states s JOIN folds f USING (subject_id) GROUP BY f.fold""",
    "image_state_ages": _with(SESSIONS, _IMAGES, _STATES) + "SELECT CASE WHEN n_images > 1 THEN 'ambiguous' WHEN n_images = 1 THEN 'one' ELSE 'none' END AS state, count(*) AS n, round(avg(age), 6) AS mean_age FROM states GROUP BY 1",
    "files_without_record": _with(SESSIONS, _IMAGES) + "SELECT raw_id FROM images WHERE raw_id NOT IN (SELECT raw_id FROM sessions WHERE raw_id IS NOT NULL)",
    "group_means": _with(SESSIONS) + "SELECT label, round(round_even(avg(age), 4), 3) AS age, round(round_even(avg(etiv), 4), 3) AS etiv, round(round_even(avg(asf), 4), 3) AS asf FROM sessions GROUP BY label",
    "describe": _with(SESSIONS) + _long("SELECT '{0}' AS feature, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std, CAST(min({0}) AS DOUBLE) AS min, CAST(max({0}) AS DOUBLE) AS max, count({0}) AS n FROM sessions", _FEATURES),
    "correlations": _with(SESSIONS) + _long("SELECT '{0}' AS feature_a, '{1}' AS feature_b, round(corr({0}, {1}), 6) AS r FROM sessions", _PAIRS),
    "group_deltas": _with(SESSIONS) + _long("SELECT '{0}' AS feature, round(avg({0}) FILTER (label = 0), 6) AS mean_cn, round(avg({0}) FILTER (label = 1), 6) AS mean_demented, round(avg({0}) FILTER (label = 1) - avg({0}) FILTER (label = 0), 6) AS delta FROM sessions", _FEATURES),
    "severity_sensitivity": _with(SESSIONS, SLICES, CLEAN, _aggregated("max")) + """, r AS (SELECT subject_id, max(cdr) AS cdr FROM sessions GROUP BY subject_id),
        p AS (SELECT r.cdr, CAST(a.score >= 0.5 AS INTEGER) AS y_pred FROM agg a JOIN r USING (subject_id) WHERE a.label = 1)
        SELECT cdr, count(*) AS n, sum(y_pred) AS detected, round(avg(y_pred), 3) AS sensitivity, CASE cdr WHEN 0.5 THEN 'very mild' WHEN 1 THEN 'mild' WHEN 2 THEN 'moderate' ELSE '?' END AS severity,
        round(count(*) / sum(count(*)) OVER (), 6) AS share FROM p GROUP BY cdr""",
    "site_counts": "SELECT site, sex, count(*) AS count FROM subject_records WHERE site IS NOT NULL AND sex IS NOT NULL GROUP BY ALL",
    "suffix_join": _with(SLICES, CLEAN, _aggregated("avg", "a"), _aggregated("max", "b")) + "SELECT subject_id, a.label AS label_mean, b.label AS label_max, round(a.score, 9) AS y_score_mean, round(b.score, 9) AS y_score_max FROM a JOIN b USING (subject_id)",
    "lookup_join": "SELECT site, record_id, (SELECT min(sheet_id) FROM sheets s WHERE s.site = r.site) AS first_sheet FROM subject_records r",
    "shuffle_global": _with(SESSIONS, LABELLED, FOLDS) + ", " + _SHUFFLE.format(g="0"),
    "shuffle_subject": _with(SLICES, CLEAN) + """, pairs AS (SELECT DISTINCT subject_id, label FROM clean),
        take AS (SELECT subject_id, row_number() OVER (ORDER BY md5('42a|' || subject_id)) AS n FROM pairs), give AS (SELECT label, row_number() OVER (ORDER BY md5('42b|' || subject_id)) AS n FROM pairs)
        SELECT c.subject_id, v.label, c.fold, c.slice_position, c.y_score FROM clean c JOIN take t USING (subject_id) JOIN give v USING (n)""",
    "shuffle_within_fold": _with(SESSIONS, LABELLED, FOLDS) + ", " + _SHUFFLE.format(g="fold"),
}
