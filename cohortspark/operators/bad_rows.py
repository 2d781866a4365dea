"""Rows that fail to parse: typed rows and the reason of each failure, in one pass and without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.tokenizer import tokenized
from cohortspark.plans.shared import checked_broadcast, ship


@dataclass(frozen=True)
class FieldRule:
    """A column of the sheets: its name there, our name, type, the pattern of valid cells, whether it may be missing.

    Patterns see the cell without outer blanks and with `.` as its decimal mark, and must match it whole.
    """

    header: str
    name: str
    kind: str
    pattern: str | None
    required: bool = False


_WHOLE_FRACTION = r"(?:\.0+)?"
METADATA_RULES = (
    FieldRule("ID", "raw_id", "string", r"OAS1_[0-9]{8}_MR[0-9]+", True),
    FieldRule("M/F", "sex", "string", r"[MF]", True),
    FieldRule("Hand", "hand", "string", r"[RL]"),
    FieldRule("Age", "age", "int", r"0*(?:1[89]|[2-9][0-9]|10[0-9]|110)", True),
    FieldRule("Educ", "education", "double", rf"0*[1-5]{_WHOLE_FRACTION}"),
    FieldRule("SES", "ses", "double", rf"0*[1-5]{_WHOLE_FRACTION}"),
    FieldRule("MMSE", "mmse", "double", rf"0*(?:[12]?[0-9]|30){_WHOLE_FRACTION}"),
    FieldRule("CDR", "cdr", "double", rf"0*[0-3]{_WHOLE_FRACTION}|0+\.50*"),
    FieldRule("eTIV", "etiv", "int", r"0*(?:9[0-9]{2}|1[0-9]{3}|2[0-4][0-9]{2}|2500)", True),
    FieldRule("nWBV", "nwbv", "double", r"0+\.(?:[5-8][0-9]*|9(?:[0-4][0-9]*|50*)?)", True),
    FieldRule("ASF", "asf", "double", rf"0+\.[6-9][0-9]*|0*1(?:\.[0-9]+)?|0*2{_WHOLE_FRACTION}", True),
    FieldRule("Delay", "delay", "int", r"0*(?:[0-9]{1,2}|[123][0-9]{2}|400)"),
    FieldRule("Comment", "comment", "string", None),
)

_SPEC = ("header", "sep_char", "decimal_mark", "na_token")


def parse_sheet_rows(rows: DataFrame, sheets: DataFrame, rules: tuple[FieldRule, ...] = METADATA_RULES) -> DataFrame:
    """Every record of `rows` once, typed where it keeps the contract of its sheet, else with the reason.

    `rows` has row_id, sheet_id, line_no, raw_line; `sheets` has sheet_id, header, sep_char (one character),
    decimal_mark, na_token. The result has row_id, sheet_id, line_no, one typed column per rule (null in failing
    rows), `reason`, `error_offset` (code points from the record's start: where the quoting breaks, where the first field too
    many starts or the record ends too early, where the wrong field starts; a required field that the sheet has no column for
    is wanted at the record's end), `error_field` (for `values`) and raw_line of failing rows. Line breaks outside quotes are
    characters like any other.

    The first that applies is the reason: `sheet` (no such sheet, or more than one row for it: the first header counts),
    `quoting`, `columns` (a null record has none), `values`. Other columns of either input, whatever their names,
    are left out; repeated rows stay repeated; empty tables give an empty result. The sheets are broadcast up to the
    bound of `checked_broadcast`; the rows are never shuffled then, so a sheet of any size spreads over all tasks.
    """
    ship(rows.sparkSession)
    spec = sheets.where(F.col("sheet_id").isNotNull()).groupBy("sheet_id").agg(
        F.min(F.struct(*_SPEC)).alias("s")
    )
    spec = spec.select("sheet_id", F.lit(True).alias("known"), *[F.col(f"s.{c}").alias(c) for c in _SPEC])
    names = F.split(F.col("header"), F.concat(F.lit("\\Q"), F.col("sep_char"), F.lit("\\E")))
    spec = spec.select(
        "sheet_id", "known", "sep_char", "decimal_mark", F.coalesce("na_token", F.lit("")).alias("na_token"),
        F.size(names).alias("n_columns"), *[F.array_position(names, r.header).cast("int").alias(f"at_{r.name}") for r in rules],
    )
    joined = rows.select("row_id", "sheet_id", "line_no", "raw_line").join(checked_broadcast(spec), "sheet_id", "left")
    split = joined.withColumn("t", tokenized("raw_line", "sep_char"))

    def cell(rule: FieldRule) -> Column:
        at = F.col(f"at_{rule.name}")
        trimmed = F.trim(F.when(at > 0, F.try_element_at(F.col("t.fields"), at)))
        return F.when((trimmed != "") & (trimmed != F.col("na_token")), trimmed)

    cells = split.withColumns({f"c_{r.name}": cell(r) for r in rules})
    point = F.col("decimal_mark") == "."
    decimals = {
        f"c_{r.name}": F.when(point, F.col(f"c_{r.name}")).otherwise(
            F.call_function("translate", F.col(f"c_{r.name}"), F.concat(F.lit("."), F.col("decimal_mark")), F.lit("\u0001."))
        )
        for r in rules
        if r.kind == "double"
    }
    cells = cells.withColumns(decimals)

    def fails(rule: FieldRule) -> Column:
        value = F.col(f"c_{rule.name}")
        bad = value.isNotNull() & ~value.rlike(rf"\A(?:{rule.pattern})\z") if rule.pattern else F.lit(False)
        return (value.isNull() | bad) if rule.required else bad

    bad_field = F.coalesce(*[F.when(fails(r), F.struct(F.lit(r.header).alias("name"), F.col(f"at_{r.name}").alias("at"))) for r in rules])

    def start_of(at: Column) -> Column:
        """Where a field starts, counted from 1; the record's end where it has none."""
        before = F.aggregate(F.slice("t.fields", 1, at - 1), F.lit(0), lambda a, f: a + F.length(f) + 1)
        return F.when((at < 1) | (at > F.size("t.fields")), F.length("raw_line")).otherwise(F.coalesce(F.try_element_at("t.starts", at), before))

    n_fields = F.coalesce(F.size("t.fields"), F.lit(0))
    reason = (
        F.when(F.col("known").isNull(), "sheet")
        .when(F.col("t.broken_at").isNotNull(), "quoting")
        .when(F.col("t.fields").isNull() | (n_fields != F.col("n_columns")), "columns")
        .when(F.col("bad_field").isNotNull(), "values")
    )
    judged = cells.withColumn("bad_field", bad_field).withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return judged.select(
        "row_id", "sheet_id", "line_no",
        *[F.when(ok, F.col(f"c_{r.name}").try_cast(r.kind)).alias(r.name) for r in rules],
        "reason",
        F.when(F.col("reason") == "quoting", F.col("t.broken_at"))
        .when(F.col("reason") == "columns", F.coalesce(start_of(F.col("n_columns") + 1), F.lit(0)))
        .when(F.col("reason") == "values", start_of(F.coalesce("bad_field.at", F.lit(0)))).alias("error_offset"),
        F.when(F.col("reason") == "values", F.col("bad_field.name")).alias("error_field"),
        F.when(~ok, F.col("raw_line")).alias("raw_line"),
    )


def failed_rows(parsed: DataFrame) -> DataFrame:
    """The failing records, with the reason."""
    return parsed.where(F.col("reason").isNotNull()).select("row_id", "sheet_id", "line_no", "reason", "error_offset", "error_field", "raw_line")


def valid_rows(parsed: DataFrame, rules: tuple[FieldRule, ...] = METADATA_RULES) -> DataFrame:
    """The typed records."""
    return parsed.where(F.col("reason").isNull()).select("row_id", "sheet_id", "line_no", *[r.name for r in rules])
