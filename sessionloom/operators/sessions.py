"""Event deduplication and session reconstruction.

A session is a fold of its events in event-time order, and the fold is kept in mergeable form:
the earliest event, the latest lifecycle event and a count. Partial folds combine by min, max
and sum, so every step aggregates map-side before it shuffles (a hot session costs one partial
row per task), and an incremental update never re-reads stored events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.lifecycle import is_terminal, lifecycle_state
from sessionloom.operators.canonical import rfc3339_text
from sessionloom.schemas import SESSION_COLUMNS

TOUCHED_SALTS = 16

FOLD_INPUT = [
    "session_id",
    "event_id",
    "event_type",
    "occurred_at",
    "occurred_at_unix_nano",
    "schema_version",
    "provider",
    "tool",
]


def deduplicate(events: DataFrame, arrival: list[str]) -> DataFrame:
    """Keep the first event per ``event_id`` by the ``arrival`` columns.

    A minimum over structs rather than a window: map-side combine reduces copies before the
    shuffle, so an id that holds a large share of all rows does not land in one task.
    """
    others = [name for name in events.columns if name not in ("event_id", *arrival)]
    order = F.struct(*[F.col(name) for name in arrival])
    first = F.min_by(F.struct(*[F.col(name) for name in [*arrival, *others]]), order)
    return (
        events.groupBy("event_id")
        .agg(first.alias("_first"))
        .select(*[F.col(name) if name == "event_id" else F.col(f"_first.{name}") for name in events.columns])
    )


def new_events(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Events whose id is not stored yet; a stored id wins even under another session."""
    return events.join(stored.select("event_id"), "event_id", "left_anti")


def _order() -> list[Column]:
    return [F.col("occurred_at_unix_nano").alias("nano"), F.col("event_id").alias("event_id")]


def fold_events(events: DataFrame) -> DataFrame:
    """Partial session folds of deduplicated events: one row per session.

    Columns: ``session_id``, ``first`` and ``last`` (structs ordered by event time and id;
    ``last`` covers lifecycle events only and may be NULL) and ``event_count``.
    """
    state = lifecycle_state(F.col("event_type"))
    first = F.struct(*_order(), "occurred_at", "schema_version", "provider", "tool")
    last = F.when(state.isNotNull(), F.struct(*_order(), "occurred_at", state.alias("state")))
    return (
        events.select("session_id", first.alias("first"), last.alias("last"))
        .groupBy("session_id")
        .agg(
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.count(F.lit(1)).alias("event_count"),
        )
    )


def merge_folds(*folds: DataFrame) -> DataFrame:
    """Combine partial folds over disjoint sets of events into one fold per session."""
    united = folds[0]
    for other in folds[1:]:
        united = united.unionByName(other)
    return united.groupBy("session_id").agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.sum("event_count").alias("event_count"),
    )


def finish_sessions(folds: DataFrame) -> DataFrame:
    """Sessions from complete folds.

    The state is that of the last lifecycle event, else ``unknown``. The session is complete
    at that event's time only when the state is terminal; a later non-terminal event reopens it.
    """
    return folds.select(
        "session_id",
        F.col("first.schema_version").alias("schema_version"),
        F.col("first.provider").alias("provider"),
        F.col("first.tool").alias("tool"),
        F.coalesce(F.col("last.state"), F.lit("unknown")).alias("state"),
        F.col("first.occurred_at").alias("started_at"),
        F.when(is_terminal(F.col("last.state")), F.col("last.occurred_at")).alias("completed_at"),
        F.col("event_count"),
    ).select(*SESSION_COLUMNS)


def rebuild_sessions(events: DataFrame) -> DataFrame:
    """Sessions of a full table of deduplicated events."""
    return finish_sessions(fold_events(events))


def rebuild_touched(events: DataFrame, batch: DataFrame) -> DataFrame:
    """Sessions that ``batch`` touches, folded again from all stored ``events``.

    The touched ids are reduced to distinct values before they meet the event table; whether
    they are broadcast is left to Spark's size check. Where they are not, a hot session would
    send all its events to one join task, so both sides carry a salt: the ids once per salt
    value, each event under the one its own id falls on. The fold combines again by session.
    """
    salts = F.explode(F.array(*[F.lit(salt) for salt in range(TOUCHED_SALTS)]))
    touched = batch.select("session_id").distinct().withColumn("_salt", salts)
    salted = events.select(*FOLD_INPUT).withColumn(
        "_salt", F.pmod(F.xxhash64("event_id"), F.lit(TOUCHED_SALTS)).cast("int")
    )
    return rebuild_sessions(salted.join(touched, ["session_id", "_salt"], "left_semi"))


def session_documents(sessions: DataFrame) -> DataFrame:
    """Sessions as the open JSON documents their contract describes (one VARIANT column)."""
    texts = ["schema_version", "session_id", "provider", "tool", "state"]
    null = F.parse_json(F.lit("null"))
    members = [F.struct(F.lit(name).alias("key"), F.col(name).cast("variant").alias("value")) for name in texts]
    members += [
        F.struct(
            F.lit(name).alias("key"),
            F.coalesce(rfc3339_text(F.col(name)).cast("variant"), null).alias("value"),
        )
        for name in ("started_at", "completed_at")
    ]
    members += [
        F.struct(
            F.lit("attributes").alias("key"),
            F.to_variant_object(F.struct(F.col("event_count").alias("event_count"))).alias("value"),
        ),
        F.struct(F.lit("provider_extensions").alias("key"), F.parse_json(F.lit("{}")).alias("value")),
    ]
    return sessions.select(
        "session_id", F.to_variant_object(F.map_from_entries(F.array(*members))).alias("document")
    )


def session_timeline(events: DataFrame, session_id: str) -> DataFrame:
    """Events of one session in event-time order."""
    return events.filter(F.col("session_id") == session_id).orderBy(
        "occurred_at_unix_nano", "event_id"
    )
