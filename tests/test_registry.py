import ast
from numbers import Number
from pathlib import Path

import numpy as np
import pytest

from cohortspark.plans import registry

PACKAGE = Path(registry.__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries()) and registry.FLAGSHIP in registry.queries()


def test_core_does_not_import_the_text_package():
    for path in PACKAGE.rglob("*.py"):
        if "llm" not in path.relative_to(PACKAGE).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any(n.startswith("cohortspark.llm") for n in names), path


@pytest.fixture(scope="module")
def sql(sf):
    connection = pytest.importorskip("duckdb").connect()
    for path in Path(sf).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(v):
    """A value as text; null and not-a-number are told apart."""
    if v is None:
        return "null"
    return f"{float(v):.6f}" if isinstance(v, (Number, np.bool_)) else str(v)


def same_rows(query, statement, spark, sf, sql):
    want, got = sql.sql(statement).to_arrow_table(), query(spark, sf).toArrow()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    rows = lambda t: sorted(tuple(map(plain, r)) for r in zip(*[t.column(c).to_pylist() for c in columns]))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_matches_sql(spark, sf, sql, name):
    same_rows(registry.queries()[name], registry.oracles()[name], spark, sf, sql)
