"""Canonical subject and session ids as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE_DIGITS = "０１２３４５６７８９"
_SUBJECT = r"(?i)oas[^0-9]*0*1[^0-9]+0*([0-9]+)"
_SESSION_IN_RAW = r"(?i)oas[^0-9]*0*1[^0-9]+[0-9]+[^0-9]+0*([0-9]+)"
_SESSION = r"(?i)mr[^0-9]*0*([0-9]+)"


def _number(text: Column, pattern: str) -> Column:
    """The digits that `pattern` captures (it leaves leading zeros out); empty where nothing matches, null for null."""
    return F.regexp_extract(F.translate(text, _WIDE_DIGITS, "0123456789"), pattern, 1)


def subject_key(subject_id: Column, raw_id: Column | None = None) -> Column:
    """`OAS1_` and eight digits, from any spelling; `raw_id` tells the subject where `subject_id` doesn't.

    Null where neither holds a number. Numbers of more than eight digits are kept whole.
    """
    def padded(text: Column) -> Column:
        n = _number(text, _SUBJECT)
        return F.when(n != "", F.concat(F.lit("OAS1_"), F.regexp_replace(F.lpad(n, 40, "0"), "^0{1,32}(?=[0-9]{8})", "")))

    # most ids are canonical as they are, and patterns cost more than all else in a scan
    canonical = subject_id.startswith("OAS1_") & (F.length(subject_id) == 13) & (F.translate(F.substring(subject_id, 6, 8), "0123456789", "") == "")
    spelled = padded(subject_id) if raw_id is None else F.coalesce(padded(subject_id), padded(raw_id))
    return F.when(canonical, subject_id).otherwise(spelled)


def session_key(session_id: Column, raw_id: Column | None = None) -> Column:
    """`MR` and the session's number without leading zeros; null where no number is given."""
    def named(text: Column, pattern: str) -> Column:
        n = _number(text, pattern)
        return F.when(n != "", F.concat(F.lit("MR"), n))

    spelled = named(session_id, _SESSION)
    if raw_id is not None:
        spelled = F.coalesce(spelled, named(raw_id, _SESSION_IN_RAW))
    canonical = session_id.between("MR1", "MR9") & (F.length(session_id) == 3)
    return F.when(canonical, session_id).otherwise(spelled)
