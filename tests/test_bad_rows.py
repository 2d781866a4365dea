import random

import numpy as np

from cohortspark.functions import tokenizer
from cohortspark.operators.bad_rows import failed_rows, parse_sheet_rows, valid_rows

HEADER = "ID;M/F;Hand;Age;Educ;SES;MMSE;CDR;eTIV;nWBV;ASF;Delay;Comment"
GOOD = "OAS1_00000001_MR1;F;R;74;2,0;;29;0,5;1344;0,743;1,306;NA;said \"\"no"
ROWS = "row_id bigint, sheet_id string, line_no bigint, raw_line string, reason string"
SHEETS = "sheet_id string, site string, header string, sep_char string, decimal_mark string, na_token string"


def by_hand(record, sep):
    """Fields, or the place at which the quoting breaks."""
    out, i, n = [], 0, len(record)
    while True:
        if i < n and record[i] == '"':
            j, text = i + 1, ""
            while True:
                if j >= n:
                    return n
                if record[j] == '"':
                    if record[j + 1 : j + 2] == '"':
                        text, j = text + '"', j + 2
                        continue
                    break
                text, j = text + record[j], j + 1
            j += 1
            if j < n and record[j] != sep:
                return j
            out.append(text)
        else:
            j = i
            while j < n and record[j] != sep:
                if record[j] == '"':
                    return j
                j += 1
            out.append(record[i:j])
        if j >= n:
            return out
        i = j + 1


def test_tokenizer_matches_reading_by_hand():
    rng = random.Random(1)
    records = ["".join(rng.choice('ab";,\n é𝄞') for _ in range(rng.choice([0, 1, 5, 20, 700]))) for _ in range(400)]
    records += ['"' + "x;" * 2000 + '";b', '"' + "y" * 3000]
    seps = [rng.choice(";,") for _ in records]
    broken, fields, starts = tokenizer.tokenize(records, seps)
    for r, s, b, f, at in zip(records, seps, broken, fields, starts):
        want = by_hand(r, s)
        assert (b if b is not None else f) == want, (r[:50], s)
        if at is not None:
            assert len(at) == len(f) and all(r[i] == '"' or r[i : i + len(x)] == x for i, x in zip(at, f) if x)


def test_states_do_not_depend_on_chunks():
    classes = np.random.default_rng(0).integers(0, 5, 3000).astype(np.uint8)
    got, state = tokenizer.states_before(classes), 0
    for c, s in zip(classes, got):
        assert s == state
        state = tokenizer._NEXT[c, state]


def test_reasons_and_types(spark):
    lines = [
        GOOD.replace('said ""no', '"said ""no"""'),
        GOOD,  # a quote in the middle of a field
        GOOD.split(";Comment")[0].rsplit(";", 1)[0],  # a field less
        GOOD.replace('said ""no', "").replace(";74;", ";17;"),
        GOOD.replace('said ""no', "").replace("2,0", "2,5"),
        GOOD.replace('said ""no', "").replace("2,0", "2.0"),
        GOOD.replace('said ""no', "").replace("0,743", "NA"),
        GOOD.replace('said ""no', "").replace(";74;", "; 0110 ;"),
        "", None,
        GOOD.replace('said ""no', "two\nlines"),  # a line break is a character like any other
        GOOD.replace('said ""no', '"x;y";"surplus"'),
        GOOD.replace('said ""no', "").replace("F;R", '"F";Q'),
    ]
    rows = spark.createDataFrame([(i, "s", i, x, "clash") for i, x in enumerate(lines)] + [(99, None, 1, GOOD, "x"), (98, "other", 1, GOOD, "x")], ROWS)
    sheets = spark.createDataFrame([("s", "a", HEADER, ";", ",", "NA")], SHEETS)
    parsed = parse_sheet_rows(rows, sheets)
    got = {r.row_id: r for r in parsed.collect()}
    assert {k: v.reason for k, v in got.items()} == {0: None, 1: "quoting", 2: "columns", 3: "values", 4: "values", 5: "values", 6: "values", 7: None, 8: "columns", 9: "columns", 10: None, 11: "columns", 12: "values", 99: "sheet", 98: "sheet"}
    assert got[1].error_offset == lines[1].index('"') and got[3].error_field == "Age" and got[6].error_field == "nWBV"
    assert (got[0].age, got[0].education, got[0].ses, got[0].cdr, got[0].comment) == (74, 2.0, None, 0.5, 'said "no"')
    offsets = {2: len(lines[2]), 3: lines[3].index("17"), 5: lines[5].index("2.0"), 6: lines[6].index("NA;1,306"), 8: 0, 9: 0, 11: lines[11].index('"surplus"'), 12: lines[12].index("Q;")}
    assert {k: got[k].error_offset for k in offsets} == offsets and got[0].error_offset is None and got[10].comment == "two\nlines"
    assert failed_rows(parsed).count() == 12 and valid_rows(parsed).count() == 3
    assert parse_sheet_rows(rows.limit(0), sheets).count() == 0
    assert {r.reason for r in parse_sheet_rows(rows, sheets.limit(0)).collect()} == {"sheet"}
