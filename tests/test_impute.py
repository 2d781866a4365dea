import datetime as dt
import math

from cohortspark.operators.impute import fill_missing, filled_cells

SCHEMA = "record_id int, subject string, site string, at timestamp, education double, ses double, mmse double, mmse_method string, _cs_e string"


def day(n):
    return dt.datetime(2024, 3, 1, 12) + dt.timedelta(days=n)


def test_methods(spark):
    nan = float("nan")
    rows = [
        (1, "a", "x", day(0), 2.0, 1.0, 20.0, "own", "kept"), (2, "a", "x", day(4), nan, 99.0, nan, "own", "kept"), (3, "a", "x", day(10), 3.0, None, 30.0, "own", "kept"),
        (4, "a", "x", day(10), 3.0, None, -1.0, "own", "kept"), (5, "b", "x", day(1), None, 4.0, None, "own", "kept"), (6, None, "x", day(40), None, None, None, "own", "kept"),
        (7, None, "y", None, 9.0, None, None, "own", "kept"), (8, "c", "y", day(2000), 5.0, 2.0, None, "own", "kept"), (9, "c", "y", day(0), None, None, None, "own", "kept"),
    ]
    filled = fill_missing(spark.createDataFrame(rows, SCHEMA), "subject", "site", "at")
    got = {r.record_id: r for r in filled.collect()}
    assert len(got) == 9 and all(r._cs_e == "kept" for r in got.values())
    assert (got[1].education_filled, got[1].education_method, got[1].education_distance) == (2.0, None, None)
    assert (got[2].mmse_filled, got[2].mmse_method, got[2].mmse_distance) == (24.0, "interpolated", 4)
    assert (got[2].education_filled, got[2].education_method, got[2].education_distance) == (2.0, "carried", 4)
    assert (got[2].ses_filled, got[2].ses_method) == (1.0, "carried") and math.isnan(got[2].education)
    assert (got[4].mmse_filled, got[4].mmse_method, got[4].mmse_distance) == (30.0, "same_day", 0)
    assert (got[5].education_filled, got[5].education_method, got[5].education_distance) == (3.0, "place_month", None)
    assert (got[6].mmse_filled, got[6].mmse_method) == (25.0, "place") and got[7].education_filled == 5.0
    assert got[9].education_method == "place" and got[8].mmse_method == "overall"  # beyond the gap limit; no other in place y
    cells = filled_cells(filled, "record_id")
    assert cells.count() == sum(v is not None for r in got.values() for v in (r.education_method, r.ses_method, r.mmse_method))


def test_empty_and_unknown(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fill_missing(none, "subject", "site", "at").count() == 0
    lone = spark.createDataFrame([(1, "a", "x", day(0), None, None, None, "", "")], SCHEMA)
    row = fill_missing(lone, "subject", "site", "at").first()
    assert row.mmse_filled is None and row.mmse_method == "none"


def test_repeated_records_and_ties(spark):
    rows = [(1, "a", "x", day(0), 2.0, None, None, "", "")] * 2 + [(2, "a", "x", day(0), 4.0, None, None, "", "")] * 2 + [(3, "a", "x", day(1), None, None, None, "", "")] * 2
    got = fill_missing(spark.createDataFrame(rows, SCHEMA), "subject", "site", "at").where("record_id = 3").collect()
    assert [r.education_filled for r in got] == [2.0, 2.0]  # of equally frequent categories the smallest
