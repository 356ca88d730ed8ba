"""Every registered query against its SQL counterpart on the smallest tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as driver  # noqa: E402
from sessionloom.plans import oracles, registry  # noqa: E402

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def connection():
    connection = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def rows(columns, data):
    order = [columns.index(name) for name in sorted(columns)]
    plain = [tuple(round(row[at], 6) if isinstance(row[at], float) else row[at] for at in order) for row in data]
    return sorted(plain, key=lambda row: tuple((value is None, str(value)) for value in row))


def test_every_query_has_a_counterpart():
    assert registry.queries().keys() == oracles.oracle_sql().keys()
    assert registry.queries().keys() <= driver.queries().keys()
    assert driver.oracle_sql().keys() <= driver.queries().keys()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, connection, name):
    frame = driver.queries()[name](spark, str(TABLES))
    result = connection.execute(driver.oracle_sql()[name])
    columns = [column[0] for column in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows(frame.columns, frame.collect()) == rows(columns, result.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_everything_else_works_without_the_corpus_operators(tmp_path, left):
    root = Path(driver.__file__).parent
    shutil.copytree(root / "sessionloom", tmp_path / "sessionloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *left):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert [line.split() for line in said.stdout.splitlines()] == [sorted(registry.queries())] * 2
