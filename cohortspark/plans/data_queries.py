"""Registered queries of the problems that belong to the core: rows that fail to parse, missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.ids import subject_key
from cohortspark.operators import bad_rows, impute
from cohortspark.plans.cohort_sql import subject
from cohortspark.sources.tables import table


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return bad_rows.parse_sheet_rows(table(spark, sf, "sheet_rows"), table(spark, sf, "sheets"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return bad_rows.failed_rows(_parsed(spark, sf)).select("row_id", "reason")


def p2_typed_rows(spark: SparkSession, sf: str) -> DataFrame:
    return bad_rows.valid_rows(_parsed(spark, sf))


def _filled(spark: SparkSession, sf: str) -> DataFrame:
    records = table(spark, sf, "subject_records").select(
        "record_id", subject_key(F.col("subject_id"), F.col("raw_id")).alias("subject"), "site", "scanned_at", "education", "ses", "mmse"
    )
    return impute.fill_missing(records, "subject", "site", "scanned_at")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return impute.filled_cells(_filled(spark, sf), "record_id").select("record_id", "field_name")


def p3_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Every record's fields as filled, with method and distance; numbers to nine decimals."""
    made = [F.round(f"{s.field}_filled", 9).alias(f"{s.field}_filled") if x == "filled" else F.col(f"{s.field}_{x}") for s in impute.CLINICAL for x in ("filled", "method", "distance")]
    return _filled(spark, sf).select("record_id", *made)


QUERIES = {"p2_found": p2_found, "p2_typed_rows": p2_typed_rows, "p3_found": p3_found, "p3_filled": p3_filled}

#: § stands for the sheet's separator. A well-formed record, and its fields once it is known to be one.
_CELL = '(?:"(?:[^"]|"")*"|[^"§]*)'
_KINDS = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE"}


def _sheet_sql() -> str:
    """Cells by name, trimmed, with `.` as decimal mark, null where missing; then the first reason that applies."""
    cells, bad = [], []
    for rule in bad_rows.METADATA_RULES:
        raw = f"f[list_position(names, '{rule.header}')]"
        text = f"CASE WHEN starts_with({raw}, '\"') THEN replace(substr({raw}, 2, length({raw}) - 2), '\"\"', '\"') ELSE {raw} END"
        cell = f"nullif(nullif(trim({text}, ' '), ''), na_token)"
        if rule.kind == "double":
            cell = f"CASE WHEN decimal_mark = '.' THEN {cell} ELSE translate({cell}, '.' || decimal_mark, chr(1) || '.') END"
        cells.append(f"{cell} AS c_{rule.name}")
        fails = f"(c_{rule.name} IS NOT NULL AND NOT regexp_full_match(c_{rule.name}, '{rule.pattern}'))" if rule.pattern else "FALSE"
        bad.append(f"(c_{rule.name} IS NULL OR {fails})" if rule.required else fails)
    return f"""
WITH r AS (SELECT *, replace(regexp_escape(sep_char), chr(92) || chr(92), chr(92)) AS sep, string_split(header, sep_char) AS names FROM sheet_rows JOIN sheets USING (sheet_id)),
q AS (SELECT *, regexp_full_match(raw_line, replace('{_CELL}(?:§{_CELL})*', '§', sep)) AS good FROM r),
l AS (SELECT *, CASE WHEN good THEN regexp_extract_all(sep_char || raw_line, replace('§({_CELL})', '§', sep), 1) END AS f FROM q),
c AS (SELECT *, {', '.join(cells)} FROM l),
j AS (SELECT *, CASE WHEN NOT good THEN 'quoting' WHEN len(f) <> len(names) THEN 'columns' WHEN {' OR '.join(bad)} THEN 'values' END AS reason FROM c)
"""


def _filled_sql() -> str:
    """Per field: typical values of days, months, places and all; the neighbouring observed days; then the first that is known."""
    parts = [f"r AS (SELECT record_id, {subject('subject_id', 'raw_id')} AS e, site, CAST(scanned_at AS DATE) AS d, date_trunc('month', scanned_at) AS m, education, ses, mmse FROM subject_records)"]
    columns, joins = ["r.record_id"], []
    for s in impute.CLINICAL:
        f, whole = s.field, "" if s.numeric else f" AND {s.field} = floor({s.field})"
        parts.append(f"{f}_o AS (SELECT record_id, e, site, d, m, CASE WHEN {f} BETWEEN {s.low} AND {s.high}{whole} THEN {f} END AS v FROM r)")
        for name, keys in (("day", "e, d"), ("month", "site, m"), ("place", "site"), ("all", "0 AS z")):
            by = "z" if name == "all" else keys
            most = f"SELECT {by}, arg_max(v, n * 100 - v) AS v FROM (SELECT {keys}, v, count(*) AS n FROM {f}_o WHERE v IS NOT NULL GROUP BY ALL) GROUP BY ALL"
            parts.append(f"{f}_{name} AS ({f'SELECT {keys}, avg(v) AS v FROM {f}_o WHERE v IS NOT NULL GROUP BY ALL' if s.numeric else most})")
        seen = "CASE WHEN y.v IS NOT NULL THEN {'d': x.d, 'v': y.v} END"
        parts.append(f"""{f}_near AS (SELECT x.e, x.d, y.v, last_value({seen} IGNORE NULLS) OVER (PARTITION BY x.e ORDER BY x.d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value({seen} IGNORE NULLS) OVER (PARTITION BY x.e ORDER BY x.d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a
  FROM (SELECT DISTINCT e, d FROM r WHERE e IS NOT NULL AND d IS NOT NULL) x LEFT JOIN {f}_day y ON x.e = y.e AND x.d = y.d)""")
        parts.append(f"{f}_gap AS (SELECT *, d - b.d AS to_b, a.d - d AS to_a FROM {f}_near)")
        line = "WHEN to_b IS NOT NULL AND to_a IS NOT NULL THEN {}" if s.numeric else ""
        pick = lambda same, between, nearest, line=line: f"CASE WHEN v IS NOT NULL THEN {same} {line.format(between)} WHEN least(to_b, to_a) <= 400 THEN {nearest} END"
        parts.append(f"""{f}_own AS (SELECT e, d, {pick('v', 'b.v + (a.v - b.v) * to_b / (to_a + to_b)', 'CASE WHEN to_b IS NOT NULL AND (to_a IS NULL OR to_b <= to_a) THEN b.v ELSE a.v END')} AS value,
  {pick("'same_day'", "'interpolated'", "'carried'")} AS method, {pick('0', 'least(to_b, to_a)', 'least(to_b, to_a)')} AS distance FROM {f}_gap)""")
        joins.append(f"JOIN {f}_o ON {f}_o.record_id = r.record_id LEFT JOIN {f}_own ON {f}_own.e = r.e AND {f}_own.d = r.d LEFT JOIN {f}_month ON {f}_month.site IS NOT DISTINCT FROM r.site AND {f}_month.m IS NOT DISTINCT FROM r.m LEFT JOIN {f}_place ON {f}_place.site IS NOT DISTINCT FROM r.site LEFT JOIN {f}_all ON TRUE")
        columns += [
            f"round(coalesce({f}_o.v, {f}_own.value, {f}_month.v, {f}_place.v, {f}_all.v), 9) + 0.0 AS {f}_filled",
            f"CASE WHEN {f}_o.v IS NULL THEN coalesce({f}_own.method, CASE WHEN {f}_month.v IS NOT NULL THEN 'place_month' WHEN {f}_place.v IS NOT NULL THEN 'place' WHEN {f}_all.v IS NOT NULL THEN 'overall' ELSE 'none' END) END AS {f}_method",
            f"CASE WHEN {f}_o.v IS NULL THEN CAST({f}_own.distance AS INTEGER) END AS {f}_distance",
        ]
    return "WITH " + ",\n".join(parts) + "\nSELECT " + ", ".join(columns) + " FROM r " + " ".join(joins)


_OFF = "({0} IS NULL OR isnan({0}) OR {0} < {1} OR {0} > {2})"
ORACLES = {
    "p3_filled": _filled_sql(),
    "p2_found": _sheet_sql() + "SELECT row_id, reason FROM j WHERE reason IS NOT NULL",
    "p2_typed_rows": _sheet_sql() + "SELECT row_id, sheet_id, line_no, " + ", ".join(f"CAST(c_{r.name} AS {_KINDS[r.kind]}) AS {r.name}" for r in bad_rows.METADATA_RULES) + " FROM j WHERE reason IS NULL",
    "p3_found": " UNION ALL ".join(
        f"SELECT record_id, '{f}' AS field_name FROM subject_records WHERE {_OFF.format(f, lo, hi)}"
        for f, lo, hi in (("education", 1, 5), ("ses", 1, 5), ("mmse", 0, 30))
    ),
}
