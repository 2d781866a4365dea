from numbers import Number
from pathlib import Path

import numpy as np
import pytest

from cohortspark.llm import queries


def plain(v):
    if v is None:
        return "null"
    return f"{float(v):.6f}" if isinstance(v, (Number, np.bool_)) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf, name):
    connection = pytest.importorskip("duckdb").connect()
    for path in Path(sf).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    want, got = connection.sql(queries.ORACLES[name]).to_arrow_table(), queries.QUERIES[name](spark, sf).toArrow()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    rows = lambda t: sorted(tuple(map(plain, r)) for r in zip(*[t.column(c).to_pylist() for c in columns]))
    assert rows(got) == rows(want)
