"""Registered corpus queries against SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from sessionloom.llm import registry

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def connection():
    connection = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, connection, name):
    frame = registry.queries()[name](spark, str(TABLES))
    result = connection.execute(registry.oracle_sql()[name])
    columns = [column[0] for column in result.description]
    assert sorted(columns) == sorted(frame.columns)
    order = sorted(columns)
    got = sorted((str([row[name] for name in order]) for row in frame.collect()))
    want = sorted(str([row[columns.index(name)] for name in order]) for row in result.fetchall())
    assert got == want


def test_all_operators_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in registry.queries()) == list(range(1, 14))
