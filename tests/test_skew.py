"""One session, one copied event and one payload may hold a third of all rows."""

from helpers import SALT, log_payload, pair, payloads
from pyspark.sql import functions as F

from sessionloom.functions.times import timestamp_to_nanos
from sessionloom.operators.sessions import deduplicate, rebuild_sessions, rebuild_touched
from sessionloom.plans.pipelines import classify_payloads, ingest_payloads

ROWS = 30_000
KINDS = ["x.created", "x.started", "note", "x.completed", "x.failed"]


def skewed(spark):
    """A third of the rows are one session, another third copies of one event."""
    kinds = F.array(*[F.lit(kind) for kind in KINDS])
    part = F.col("id") % 3
    return (
        spark.range(0, ROWS, 1, 6)
        .select(
            F.when(part == 1, "copied").otherwise(F.concat(F.lit("e"), F.col("id"))).alias("event_id"),
            F.when(part == 0, "hot").when(part == 1, "copies").otherwise(
                F.concat(F.lit("s"), F.col("id") % 100)
            ).alias("session_id"),
            F.get(kinds, (F.col("id") % 5).cast("int")).alias("event_type"),
            F.timestamp_seconds(1_700_000_000 + F.pmod(F.col("id") * 7919, F.lit(50_000))).alias("occurred_at"),
            F.lit("0.1.0").alias("schema_version"),
            F.lit("openai").alias("provider"),
            F.lit("codex").alias("tool"),
            F.col("id").alias("ingest_seq"),
        )
        .withColumn("occurred_at_unix_nano", timestamp_to_nanos(F.col("occurred_at")))
    )


def brute_force(rows):
    first = {}
    for row in sorted(rows, key=lambda row: row.ingest_seq):
        first.setdefault(row.event_id, row)
    grouped = {}
    for row in sorted(first.values(), key=lambda row: (row.occurred_at, row.event_id)):
        grouped.setdefault(row.session_id, []).append(row)
    result = {}
    for name, events in grouped.items():
        state, done = "unknown", None
        for event in events:
            if event.event_type != "note":
                state = {"started": "active"}.get(event.event_type[2:], event.event_type[2:])
                done = event.occurred_at if state in ("completed", "failed") else None
        result[name] = (state, events[0].occurred_at, done, len(events))
    return result


def summary(sessions):
    return {row.session_id: (row.state, row.started_at, row.completed_at, row.event_count) for row in sessions.collect()}


def test_hot_session_and_copied_event_are_folded_whole(spark):
    events = skewed(spark)
    unique = deduplicate(events, ["ingest_seq"])
    expected = brute_force(events.collect())
    assert expected["hot"][3] == ROWS // 3 and expected["copies"][3] == 1
    assert summary(rebuild_sessions(unique)) == expected


def test_hot_session_is_salted_when_it_is_touched(spark):
    unique = deduplicate(skewed(spark), ["ingest_seq"])
    expected = brute_force(unique.collect())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        touched = rebuild_touched(unique, unique.filter(F.col("event_type") == "x.failed"))
        plan = touched._jdf.queryExecution().executedPlan().toString()
        found = summary(touched)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    failed = {row.session_id for row in unique.filter(F.col("event_type") == "x.failed").collect()}
    assert "SortMergeJoin [session_id" in plan and "_salt" in plan
    assert found == {name: expected[name] for name in failed}


def test_one_payload_repeated_everywhere_is_one_event(spark, store):
    body = log_payload({"attributes": [pair("event.name", stringValue="x.created")], "timeUnixNano": "1"})
    rows = [(str(at), "logs", body) for at in range(300)]
    ingest_payloads(payloads(spark, rows), store, SALT, "load")
    assert store.events().count() == 1
    assert store.counters().first().accepted_payloads == 300


def test_one_payload_with_many_records_keeps_all(spark):
    from sessionloom.operators.logs import log_events

    records = [{"timeUnixNano": str(at)} for at in range(3000)]
    events = log_events(classify_payloads(payloads(spark, [("p", "logs", log_payload(*records))])), SALT)
    assert events.select("event_id").distinct().count() == 3000
