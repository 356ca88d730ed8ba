import json
import os

import pytest
from helpers import SALT, by, events, log_payload, pair, payloads, utc
from pyspark.sql import functions as F

from sessionloom.operators.privacy import sanitise_events
from sessionloom.operators.query import SessionFilter, list_sessions
from sessionloom.operators.sessions import rebuild_sessions
from sessionloom.plans.pipelines import ingest_payloads, inspect_latest
from sessionloom.schemas import PAYLOAD_SCHEMA
from sessionloom.sources.payloads import (
    read_document_files,
    read_payload_files,
    stream_payload_files,
    stream_payload_table,
)
from sessionloom.sources.store import EventStore
from sessionloom.streaming.ingest import gate_counts_by_minute, recent_unique_events, stream_events, stream_payloads

ARRIVAL = ["ingest_seq"]
ROWS = [
    ("a1", "a", "x.created", "2026-01-02T09:00:00", "m"),
    ("a2", "a", "x.completed", "2026-01-02T10:00:00", None, {"prompt": "secret-like"}),
    ("b1", "b", "x.failed", "2026-01-02T11:00:00"),
]


def safe(spark, rows):
    return sanitise_events(events(spark, rows), SALT)


def expected(spark, rows):
    return by(rebuild_sessions(events(spark, rows)), "session_id")


def test_appends_are_idempotent_and_merge_late_events(spark, store):
    store.append(safe(spark, ROWS[1:]), ARRIVAL, "1")
    store.append(safe(spark, ROWS), ARRIVAL, "2")
    store.append(safe(spark, [("a2", "other", "x.failed", "2026-01-03T00:00:00")]), ARRIVAL, "3")
    assert by(store.sessions(), "session_id") == expected(spark, ROWS)
    assert sorted(row.event_id for row in store.events().collect()) == ["a1", "a2", "b1"]
    assert [row.event_id for row in store.session_events("a").collect()] == ["a1", "a2"]
    stored = store.events().select(F.to_json(F.struct("*"))).collect()
    assert "secret-like" not in str(stored)
    kinds = store.provenance().filter("path = 'provider_extensions.prompt'").select("event_id", "action").collect()
    assert [tuple(row) for row in kinds] == [("a2", "removed")]
    entries = safe(spark, ROWS).agg(F.sum(F.size("provenance"))).first()[0]
    assert store.provenance().count() == entries


def test_a_replayed_batch_is_stored_once(spark, store):
    for _ in range(2):
        store.append(safe(spark, ROWS), ARRIVAL, "load")
    assert store.events().count() == 3 and store.table("ids").count() == 3
    assert by(store.sessions(), "session_id") == expected(spark, ROWS)


def state(spark, store):
    return (
        by(store.sessions(), "session_id"),
        sorted(row.event_id for row in store.events().collect()),
        sorted(row.event_id for row in store.table("ids").collect()),
        store.provenance().count(),
        store.counters().first(),
        sorted(store.rejected().collect()),
    )


@pytest.mark.parametrize("step", ["_write_ids", "_write_sessions"])
def test_a_batch_that_died_is_completed_by_its_replay(spark, store, tmp_path, monkeypatch, step):
    def rows(*numbers):
        return payloads(spark, [(f"p{number}", "logs", good(number)) for number in numbers] + [("bad", "logs", "{")])

    def lost(*args, **values):
        raise RuntimeError("driver lost")

    whole = EventStore.create(spark, str(tmp_path / "whole"), buckets=3)
    for target in (whole, store):
        ingest_payloads(rows(1, 2), target, SALT, "s-0")
    ingest_payloads(rows(2, 3), whole, SALT, "s-1")
    with monkeypatch.context() as patch:
        patch.setattr(EventStore, step, lost)
        with pytest.raises(RuntimeError):
            ingest_payloads(rows(2, 3), store, SALT, "s-1")
    ingest_payloads(rows(2, 3), store, SALT, "s-1")
    assert state(spark, store) == state(spark, whole)


def test_known_ids_are_read_from_the_buckets_of_the_batch(spark, store):
    store.append(safe(spark, ROWS), ARRIVAL, "1")
    plan = store._known(safe(spark, ROWS[:1]), "2")._jdf.queryExecution().executedPlan().toString()
    filters = next(part.partition("]")[0] for part in plan.split("PartitionFilters: [")[1:])
    assert "id_bucket" in filters and "NOT (batch" in filters


def test_rejected_payloads_are_kept_without_their_content(spark, store):
    rows = [("ok", "logs", good(1)), ("cut", "logs", '{"secret":'), ("type", "logs", log_payload({"timeUnixNano": 1})), ("none", "traces", "{}")]
    ingest_payloads(payloads(spark, rows), store, SALT, "b")
    assert by(store.rejected(), "payload_id", "signal", "error_code") == {
        "cut": ("logs", "malformed_payload"),
        "type": ("logs", "normalization_failed"),
        "none": ("traces", "invalid_payload"),
    }
    assert store.rejected().columns == ["payload_id", "signal", "received_at", "error_code"]
    assert "secret" not in stored_bytes(spark, store)


def test_empty_batch(spark, store):
    store.append(safe(spark, ROWS).limit(0), ARRIVAL, "none")
    assert store.events().count() == 0 and store.sessions().count() == 0
    assert store.counters().first().asDict() == {"accepted_payloads": 0, "rejected_payloads": 0}


def stored_bytes(spark, store):
    """Every row of every file below the store's root, as text."""
    rows = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(store.root)
    return " ".join(str(row) for row in rows.collect())


def test_rewrite_leaves_no_deleted_bytes(spark, store, tmp_path):
    store.append(safe(spark, ROWS[:2]), ARRIVAL, "1")
    store.append(safe(spark, ROWS[2:]), ARRIVAL, "2")
    gone = spark.createDataFrame([("a",), ("none",)], "session_id string")
    left = store.rewrite(str(tmp_path / "left"), gone)
    assert by(left.sessions(), "session_id") == expected(spark, ROWS[2:])
    assert [row.event_id for row in left.events().collect()] == ["b1"]
    assert left.provenance().filter("event_id <> 'b1'").count() == 0
    assert "a1" not in stored_bytes(spark, left) and "b1" in stored_bytes(spark, left)
    # The source is as it was, and a deleted session's events may be sent again.
    assert by(store.sessions(), "session_id") == expected(spark, ROWS)
    left.append(safe(spark, ROWS[:1]), ARRIVAL, "3")
    assert by(left.sessions(), "session_id") == expected(spark, [ROWS[0], ROWS[2]])


def test_only_the_last_two_versions_of_the_sessions_stay(spark, store):
    for at, row in enumerate(ROWS):
        store.append(safe(spark, [row]), ARRIVAL, str(at))
    assert store._versions() == [1, 2]
    assert by(store.sessions(), "session_id") == expected(spark, ROWS)


def test_session_lookup_reads_one_bucket(spark, store):
    store.append(safe(spark, ROWS), ARRIVAL, "1")
    plan = store.session_events("a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(session_bucket" in plan and "EqualTo(session_id,a)" in plan


def test_time_filters_reach_the_scan(spark, store):
    store.append(safe(spark, ROWS[:2]), ARRIVAL, "1")
    store.append(safe(spark, ROWS[2:]), ARRIVAL, "2")
    wanted = SessionFilter(started_after=utc("2026-01-02T10:30:00"))
    page = list_sessions(store.sessions(), wanted)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(started_at" in plan and "Aggregate" not in plan
    assert [row.session_id for row in page.collect()] == ["b"]
    by_model = list_sessions(store.sessions(), SessionFilter(model="m"), store.events())
    assert "EqualTo(model,m)" in by_model._jdf.queryExecution().executedPlan().toString()
    assert [row.session_id for row in by_model.collect()] == ["a"]


def test_reopened_store_keeps_its_buckets(spark, store):
    assert EventStore(spark, store.root).buckets == 4


def good(number):
    return log_payload({"attributes": [pair("event.name", stringValue="x.completed")], "timeUnixNano": str(number)})


def test_ingest_counts_in_the_same_pass(spark, store):
    batch = payloads(
        spark,
        [
            ("1", "logs", good(1)),
            ("2", "logs", good(1)),
            ("3", "logs", log_payload({}, resource={})),
            ("4", "logs", "{"),
            ("5", "logs", log_payload({"timeUnixNano": 1})),
            ("6", "traces", '{"resourceSpans":[{}]}'),
        ],
    )
    ingest_payloads(batch, store, SALT, "load")
    assert store.counters().first().asDict() == {"accepted_payloads": 4, "rejected_payloads": 2}
    assert [row.state for row in store.sessions().collect()] == ["completed"]


def test_latest_payload_is_sanitised(spark):
    body = log_payload({"attributes": [pair("user.email", stringValue="x@example.test")], "body": {"stringValue": "b"}})
    older = payloads(spark, [("old", "logs", good(1))], at="2026-07-28T11:00:00")
    newest = payloads(spark, [("new", "logs", body), ("bad", "logs", "{")])
    row = inspect_latest(older.unionByName(newest), SALT).select("payload_id", F.to_json("payload").alias("text")).first()
    assert row.payload_id == "new" and "x@example.test" not in row.text and '"body"' not in row.text
    assert inspect_latest(payloads(spark, [("bad", "logs", "{")]), SALT).count() == 0


def test_stream_equals_batch_and_restarts(spark, store, tmp_path):
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")

    def land(*numbers):
        rows = [(f"p{number}", "logs", good(number)) for number in numbers]
        payloads(spark, rows).coalesce(1).write.mode("append").parquet(landing)

    def run():
        stream = stream_payload_table(spark, landing, max_files_per_trigger=1)
        stream_payloads(stream, store, SALT, "landing", checkpoint).awaitTermination()

    land(1, 2)
    land(2, 3)
    run()
    land(3, 4)
    run()
    batch = EventStore.create(spark, str(tmp_path / "batch"), buckets=2)
    ingest_payloads(spark.read.schema(PAYLOAD_SCHEMA).parquet(landing), batch, SALT, "load")
    assert by(store.sessions(), "session_id") == by(batch.sessions(), "session_id")
    assert store.sessions().count() == 4
    assert store.counters().collect() == batch.counters().collect()


def test_event_stream_and_bounded_deduplication(spark, store, tmp_path):
    landing = str(tmp_path / "landing")
    safe(spark, ROWS + ROWS[:1]).coalesce(1).write.parquet(landing)
    schema = spark.read.parquet(landing).schema
    stream = spark.readStream.schema(schema).parquet(landing)
    stream_events(stream, store, ARRIVAL, "events", str(tmp_path / "one")).awaitTermination()
    assert by(store.sessions(), "session_id") == expected(spark, ROWS)
    unique = recent_unique_events(spark.readStream.schema(schema).parquet(landing), "1 hour")
    counted = unique.writeStream.format("memory").queryName("unique").option("checkpointLocation", str(tmp_path / "two"))
    counted.trigger(availableNow=True).start().awaitTermination()
    assert spark.table("unique").count() == 3


def test_gate_counts_per_minute(spark, tmp_path):
    landing = str(tmp_path / "landing")
    payloads(spark, [("1", "logs", good(1)), ("2", "logs", "{")]).coalesce(1).write.parquet(landing)
    counts = gate_counts_by_minute(stream_payload_table(spark, landing))
    query = counts.writeStream.format("memory").queryName("minutes").outputMode("complete")
    query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(row)[1:] for row in spark.table("minutes").collect()] == [(1, 1)]


def test_file_sources(spark, tmp_path):
    folder = tmp_path / "in"
    os.makedirs(folder)
    (folder / "a.json").write_text(json.dumps({"resourceLogs": [{}]}, indent=1))
    row = read_payload_files(spark, str(folder), "logs").first()
    assert json.loads(row.body) == {"resourceLogs": [{}]} and row.payload_id.endswith("a.json")
    assert (row.signal, row.content_type) == ("logs", "application/json") and row.received_at is not None
    assert read_document_files(spark, str(folder)).first().document_id == row.payload_id
    with pytest.raises(ValueError, match="signal"):
        read_payload_files(spark, str(folder), "metrics")


def test_file_stream_feeds_the_store(spark, store, tmp_path):
    folder = tmp_path / "landing"
    os.makedirs(folder)
    for number in (1, 2):
        (folder / f"{number}.json").write_text(good(number) + "\n")
    (folder / "bad.json").write_text("{")
    stream = stream_payload_files(spark, str(folder), "logs")
    stream_payloads(stream, store, SALT, "files", str(tmp_path / "checkpoint")).awaitTermination()
    assert store.sessions().count() == 2
    assert store.counters().first().asDict() == {"accepted_payloads": 2, "rejected_payloads": 1}
