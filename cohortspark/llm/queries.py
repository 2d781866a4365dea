"""Registered queries of the llm subpackage and the SQL they are compared with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.cells import on_scale, present
from cohortspark.functions.ids import session_key, subject_key
from cohortspark.llm import leaks, mixing, percentiles, sentences, splits, survivor
from cohortspark.plans.shared import written
from cohortspark.sources.tables import table

P1_FIELDS = ["nwbv", "etiv", "cdr", "age"]
P1_PERCENTS = [5.0, 25.0, 50.0, 75.0, 95.0]
SPLIT_SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _state(spark: SparkSession, sf: str) -> DataFrame:
    days = {"site": F.col("site"), "batch_day": F.to_date("batch_day")}
    return percentiles.value_counts(table(spark, sf, "subject_records"), days, P1_FIELDS)


def p1_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Of each site: every day, every run of seven days and every month, from one state of days.

    `days` is the span (1, 7, month), `last_day` the calendar day it ends with.
    """
    state = written(_state(spark, sf), "percentile-days")
    rest = [c for c in state.columns if c != "batch_day"]
    spans = {"1": state, "7": percentiles.trailing(state, "batch_day", 7), "month": percentiles.merged(state, {"site": F.col("site"), "batch_day": F.last_day("batch_day")})}
    parts = [s.select(F.lit(k).alias("days"), F.col("batch_day").alias("last_day"), *rest) for k, s in spans.items()]
    result = percentiles.exact_percentiles(reduce(DataFrame.unionByName, parts), ["days", "site", "last_day"], P1_PERCENTS)
    return result.withColumn("last_day", F.col("last_day").cast("string"))


def p1_union_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Of each site and month: the states of its days merged."""
    months = percentiles.merged(_state(spark, sf), {"site": F.col("site"), "month": F.trunc("batch_day", "month")})
    return percentiles.exact_percentiles(months, ["site", "month"], P1_PERCENTS).withColumn("month", F.col("month").cast("string"))


def p1_overall_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return percentiles.exact_percentiles(percentiles.merged(_state(spark, sf), {}), [], P1_PERCENTS)


def _subjects(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "subject_records").select(subject_key(F.col("subject_id"), F.col("raw_id")).alias("subject_id"), "label")
    return keyed.where(F.col("subject_id").isNotNull()).groupBy("subject_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("label") == 1).alias("n_positive"))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    confirmed = table(spark, sf, "subject_links").where(F.col("is_confirmed"))
    return confirmed.select(subject_key(F.col("subject_a")).alias("subject_a"), subject_key(F.col("subject_b")).alias("subject_b"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.related_groups(_subjects(spark, sf), _links(spark, sf))


def p4_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_subjects(_subjects(spark, sf), _links(spark, sf), SPLIT_SHARES)


def p4_split_report(spark: SparkSession, sf: str) -> DataFrame:
    found = splits.split_report(p4_splits(spark, sf), SPLIT_SHARES)
    return found.select("split", "n_subjects", "n_rows", *[F.round(c, 9).alias(c) for c in ("row_share", "deviation", "positive_share")])


def _resolved(spark: SparkSession, sf: str) -> survivor.Resolution:
    """Sources are the sites' deliveries of one rank: subjects mostly stay with a site, whose deliveries differ in trust."""
    c = F.col
    records = table(spark, sf, "subject_records").select(
        "record_id", F.concat_ws("/", "site", "source_rank").alias("source"), "source_rank", "updated_at", "education", "ses", "mmse", "cdr", "nwbv",
        subject_key(c("subject_id"), c("raw_id")).alias("subject"), session_key(c("session_id"), c("raw_id")).alias("session"),
    )
    fields = {"education": on_scale(c("education"), 1, 5), "ses": on_scale(c("ses"), 1, 5), "mmse": on_scale(c("mmse"), 0, 30), "cdr": present(c("cdr")), "nwbv": present(c("nwbv"))}
    return survivor.resolve(records, ["subject", "session"], fields, source="source")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).survivors().select("group_id", "field_name", "record_id")


def p5_judged_values(spark: SparkSession, sf: str) -> DataFrame:
    """What the sources say, without the order of ranks and dates."""
    return _resolved(spark, sf).facts.where("judged_true").select("group_id", "field_name", "value", "record_id", "n_records", "p_true")


def p5_source_quality(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).report()


def p5_overruled(spark: SparkSession, sf: str) -> DataFrame:
    """Where the order of p5_found and the sources' quality choose different values."""
    return survivor.overruled(_resolved(spark, sf).facts)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p6_leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items that leaked, with the number of documents and the best score."""
    found = leaks.find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("score").alias("best_score"))


def _mix(spark: SparkSession, sf: str) -> mixing.Mix:
    """The kind of site (the first label of the host: docs, old, www) stands for the topic."""
    documents = table(spark, sf, "documents").select("doc_id", "text", "source", "lang", F.regexp_extract("host", r"^([^.]*)\.", 1).alias("topic"))
    return mixing.plan_mix(documents, table(spark, sf, "mix_targets"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).documents().select("doc_id", "source", "n_tokens", "copies")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    plan = _mix(spark, sf)
    return plan.shares(plan.documents())


def p7_margins(spark: SparkSession, sf: str) -> DataFrame:
    """Sources, languages and topics: their shares of the corpus, of the mix as raked, and of the mix as drawn."""
    plan = _mix(spark, sf)
    return plan.margins(plan.documents())


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf, "documents")).select("doc_id", "end_pos")


QUERIES = {
    "p1_percentiles": p1_percentiles,
    "p1_union_percentiles": p1_union_percentiles,
    "p1_overall_percentiles": p1_overall_percentiles,
    "p4_found": p4_found,
    "p4_splits": p4_splits,
    "p4_split_report": p4_split_report,
    "p5_found": p5_found,
    "p5_judged_values": p5_judged_values,
    "p5_source_quality": p5_source_quality,
    "p5_overruled": p5_overruled,
    "p6_found": p6_found,
    "p6_leaked_items": p6_leaked_items,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_margins": p7_margins,
    "p8_found": p8_found,
}


def _percentile_sql(groups: str) -> str:
    columns = ", ".join(f"quantile_cont(value, {p / 100}) AS p{p:g}" for p in P1_PERCENTS)
    long = " UNION ALL ".join(f"SELECT *, '{f}' AS field_name, CAST({f} AS DOUBLE) AS value FROM r WHERE {f} IS NOT NULL AND NOT isnan(CAST({f} AS DOUBLE))" for f in P1_FIELDS)
    picked = {"site": "site", "month": "CAST(CAST(date_trunc('month', batch_day) AS DATE) AS VARCHAR) AS month"}
    names = [g for g in groups.split(", ") if g]
    select = "".join(f"{picked[g]}, " for g in names)
    return f"WITH r AS (SELECT site, batch_day, nwbv, etiv, cdr, age FROM subject_records), l AS ({long}) SELECT {select}field_name, count(*) AS n, CAST(0 AS DOUBLE) AS error_bound, {columns} FROM l GROUP BY ALL"


def _span_sql() -> str:
    """Days, runs of seven days and months, each as rows of values under the last day."""
    columns = ", ".join(f"quantile_cont(value, {p / 100}) AS p{p:g}" for p in P1_PERCENTS)
    long = " UNION ALL ".join(f"SELECT site, batch_day, '{f}' AS field_name, CAST({f} AS DOUBLE) AS value FROM subject_records WHERE {f} IS NOT NULL AND NOT isnan(CAST({f} AS DOUBLE))" for f in P1_FIELDS)
    return f"""WITH l AS ({long}),
s AS (SELECT '1' AS days, site, CAST(batch_day AS DATE) AS last_day, field_name, value FROM l
  UNION ALL SELECT '7', site, CAST(batch_day AS DATE) + CAST(k AS INTEGER), field_name, value FROM l, range(7) AS r(k) WHERE batch_day IS NOT NULL OR k = 0
  UNION ALL SELECT 'month', site, last_day(batch_day), field_name, value FROM l)
SELECT days, site, CAST(last_day AS VARCHAR) AS last_day, field_name, count(*) AS n, CAST(0 AS DOUBLE) AS error_bound, {columns} FROM s GROUP BY ALL"""


_DIGITS = "translate({}, '０１２３４５６７８９', '0123456789')"
_SUBJECT_SQL = "NULLIF(regexp_extract(" + _DIGITS + r", '(?i)oas[^0-9]*0*1[^0-9]+([0-9]+)', 1), '')"
_SESSION_SQL = "NULLIF(regexp_extract(" + _DIGITS + r", '(?i)mr[^0-9]*([0-9]+)', 1), '')"
_RAW_SESSION_SQL = "NULLIF(regexp_extract(" + _DIGITS + r", '(?i)oas[^0-9]*0*1[^0-9]+[0-9]+[^0-9]+([0-9]+)', 1), '')"
_CANONICAL = "'OAS1_' || lpad(CAST(CAST({} AS BIGINT) AS VARCHAR), 8, '0')"


def _canonical(*columns: str) -> str:
    return _CANONICAL.format("coalesce(" + ", ".join(_SUBJECT_SQL.format(c) for c in columns) + ")")


_P4_FOUND = f"""
WITH RECURSIVE s AS (SELECT DISTINCT {_canonical('subject_id', 'raw_id')} AS id FROM subject_records),
l AS (SELECT DISTINCT {_canonical('subject_a')} AS a, {_canonical('subject_b')} AS b FROM subject_links WHERE is_confirmed),
e AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
pairs AS (SELECT DISTINCT r.a, r.b FROM reach r JOIN s x ON r.a = x.id JOIN s y ON r.b = y.id)
SELECT a AS subject_id, min(b) AS group_id FROM pairs GROUP BY a HAVING count(*) > 1
"""

_P4_ENDS = splits.bounds(SPLIT_SHARES)
_P4_SPLIT = "CASE " + " ".join(f"WHEN spot < {end} THEN '{name}'" for name, end in _P4_ENDS.items()) + f" ELSE '{list(_P4_ENDS)[-1]}' END"
_P4_DEVIATION = "greatest(" + ", ".join(f"abs(sum(CASE WHEN split = '{s}' THEN rows ELSE 0 END) / max(total) - {share})" for s, share in SPLIT_SHARES.items()) + ")"
_P4_SPLITS = _P4_FOUND.replace("SELECT a AS subject_id, min(b) AS group_id FROM pairs GROUP BY a HAVING count(*) > 1", f"""
, found AS (SELECT a AS subject_id, min(b) AS group_id FROM pairs GROUP BY a HAVING count(*) > 1),
weights AS (SELECT {_canonical('subject_id', 'raw_id')} AS subject_id, count(*) AS n_rows, count(*) FILTER (label = 1) AS n_positive FROM subject_records GROUP BY 1 HAVING subject_id IS NOT NULL),
members AS (SELECT w.*, coalesce(f.group_id, w.subject_id) AS group_id FROM weights w LEFT JOIN found f USING (subject_id)),
sized AS (SELECT group_id, sum(n_rows) AS rows, sum(n_positive) > 0 AS stratum FROM members GROUP BY group_id),
placed AS (SELECT group_id, rows, stratum, sum(rows) OVER (PARTITION BY stratum) AS total,
  (2 * sum(rows) OVER (PARTITION BY stratum ORDER BY md5('42|' || group_id), group_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - rows) / (2 * sum(rows) OVER (PARTITION BY stratum)) AS place FROM sized),
turned AS (SELECT *, place + turn / {splits.TURNS} - floor(place + turn / {splits.TURNS}) AS spot FROM placed, range({splits.TURNS}) AS t(turn)),
tried AS (SELECT *, {_P4_SPLIT} AS split FROM turned),
off AS (SELECT stratum, turn, round({_P4_DEVIATION}, 9) AS off FROM tried GROUP BY stratum, turn),
best AS (SELECT stratum, turn FROM off QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY off, turn) = 1),
splits AS (SELECT m.subject_id, m.group_id, m.n_rows, m.n_positive, t.split FROM members m JOIN tried t USING (group_id) JOIN best b ON t.stratum = b.stratum AND t.turn = b.turn)
SELECT * FROM splits""")
_P4_REPORT = _P4_SPLITS.replace("SELECT * FROM splits", f"""SELECT split, count(*) AS n_subjects, sum(n_rows) AS n_rows, round(sum(n_rows) / sum(sum(n_rows)) OVER (), 9) AS row_share,
round(sum(n_rows) / sum(sum(n_rows)) OVER () - CASE {" ".join(f"WHEN split = '{s}' THEN {share}" for s, share in SPLIT_SHARES.items())} END, 9) AS deviation, round(sum(n_positive) / sum(n_rows), 9) AS positive_share FROM splits GROUP BY split""")

_P5_VALID = {"education": "education BETWEEN 1 AND 5", "ses": "ses BETWEEN 1 AND 5", "mmse": "mmse BETWEEN 0 AND 30", "cdr": "cdr IS NOT NULL AND NOT isnan(cdr)", "nwbv": "nwbv IS NOT NULL AND NOT isnan(nwbv)"}
_P5_FOUND = f"""
WITH k AS (SELECT *, {_canonical('subject_id', 'raw_id')} AS s, CAST(coalesce({_SESSION_SQL.format('session_id')}, {_RAW_SESSION_SQL.format('raw_id')}) AS BIGINT) AS m FROM subject_records),
g AS (SELECT *, min(record_id) OVER (PARTITION BY s, m) AS group_id, count(*) OVER (PARTITION BY s, m) AS size FROM k WHERE s IS NOT NULL AND m IS NOT NULL),
c AS ({" UNION ALL ".join(f"SELECT group_id, '{f}' AS field_name, record_id, source_rank, updated_at FROM g WHERE size > 1 AND {v}" for f, v in _P5_VALID.items())})
SELECT group_id, field_name, record_id FROM c
QUALIFY row_number() OVER (PARTITION BY group_id, field_name ORDER BY source_rank NULLS LAST, updated_at DESC NULLS LAST, record_id) = 1
"""

ORACLES = {
    "p1_percentiles": _span_sql(),
    "p1_union_percentiles": _percentile_sql("site, month"),
    "p1_overall_percentiles": _percentile_sql(""),
    "p4_found": _P4_FOUND,
    "p4_splits": _P4_SPLITS,
    "p4_split_report": _P4_REPORT,
    "p5_found": _P5_FOUND,
}
