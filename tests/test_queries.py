"""Every registered query against its SQL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_point
from tests.conftest import SMALL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN",
}
QUERIES = entry_point.queries()
SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS FROM '{SMALL}/{table}.parquet'")
    yield connection
    connection.close()


def test_every_query_has_sql():
    """But for those of the text operators that no SQL can express."""
    without = {name for name in set(QUERIES) - set(SQL)}
    assert set(SQL) <= set(QUERIES)
    assert all(name == "pipeline" or name.startswith("op") for name in without)


def _sortable(rows):
    return sorted(rows, key=lambda row: [(value is not None, repr(value)) for value in row])


@pytest.mark.parametrize("name", [name for name in QUERIES if name in SQL])
def test_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, SMALL)
    expected = duck.sql(SQL[name])
    columns = sorted(result.columns)
    assert columns == sorted(expected.columns)
    types = dict(zip(expected.columns, map(str, expected.types), strict=True))
    assert {f.name: TYPES[f.dataType.simpleString()] for f in result.schema} == types
    rows = [tuple(row[c] for c in columns) for row in result.collect()]
    wanted = expected.select(*[duckdb.ColumnExpression(c) for c in columns])
    assert _sortable(rows) == _sortable(wanted.fetchall())


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    years = [row["release_year"] for row in rows]
    assert years == sorted(years) and len(years) == 7
