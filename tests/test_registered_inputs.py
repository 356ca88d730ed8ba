"""Inputs of the registered queries are dealt evenly, however the files they come from are cut."""

import gzip
import json
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sessionloom.plans import derived, registry

ROWS = 2_000


@pytest.fixture
def tables(tmp_path, monkeypatch):
    """An events table in one row group, which one task reads whole, and small limits for a task."""
    monkeypatch.setattr(derived, "ROWS_A_TASK", 100)
    kinds = ["signup", "view", "purchase", "error"]
    rows = {
        "event_id": pa.array(range(ROWS), pa.int64()),
        "ts": pa.array([1_704_067_200_000_000 + at * 977_000_000 for at in range(ROWS)], pa.timestamp("us")),
        "user_id": pa.array([at % 37 for at in range(ROWS)], pa.int64()),
        "event_type": [kinds[at % 4] for at in range(ROWS)],
        "value": [1.0] * ROWS,
        "props": [json.dumps({"k": at % 90}) for at in range(ROWS)],
    }
    pq.write_table(pa.table(rows), tmp_path / "events.parquet")
    return str(tmp_path)


@pytest.fixture
def small_splits(spark):
    """Settings under which the one row group is read by many tasks, all but one of them without rows."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, "1k")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def most_in_a_task(frame):
    return frame.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("view", ["raw_payloads", "wrapped_documents", "event", "policy", "settings", "arriving"])
def test_no_task_holds_a_row_group(spark, tables, small_splits, view):
    if view in ("raw_payloads", "wrapped_documents"):
        rows = getattr(derived, view)(spark, tables)
    elif view == "arriving":
        rows = derived.arriving_events(spark, tables, even=True)
    else:
        rows = derived.contract_documents(spark, tables, view)
    assert most_in_a_task(derived.table(spark, tables, "events")) == ROWS
    copies = 2 if view == "arriving" else 1
    assert most_in_a_task(rows) <= 110 * copies
    assert rows.count() == ROWS * copies


def test_payload_lines_are_landed_compressed(spark, tables):
    payloads = derived.raw_payloads(spark, tables)
    folder = Path(registry._landed(payloads, "payloads"))
    files = list(folder.glob("part-*.gz"))
    plain = b"".join(gzip.decompress(file.read_bytes()) for file in files)
    assert len(plain.splitlines()) == ROWS
    assert sum(file.stat().st_size for file in files) < len(plain) / 10


def test_landed_files_grow_in_number(spark, tables, tmp_path):
    rows = derived.arriving_events(spark, tables).select("event_id", "ingest_seq")
    path, files = registry._landed_table(rows, str(tmp_path / "few"), 4, "ingest_seq")
    assert files == 40 and len(list(Path(path).glob("part-*"))) == 40
    assert spark.read.parquet(path).count() == 2 * ROWS
