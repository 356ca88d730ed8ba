"""Continuous ingest of payload and event streams into an event store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionloom.operators.gate import gate_payloads
from sessionloom.plans.pipelines import ingest_payloads
from sessionloom.schemas import LOG_SERVICES
from sessionloom.sources.store import EventStore


def _start(stream: DataFrame, process, checkpoint: str, trigger: dict) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def stream_payloads(
    payloads: DataFrame,
    store: EventStore,
    salt: bytes,
    name: str,
    checkpoint: str,
    services: Sequence[str] = LOG_SERVICES,
    **trigger,
) -> StreamingQuery:
    """Ingest a stream of raw payloads.

    Each micro-batch goes through the batch plan. Late, repeated and out-of-order records need
    no watermark: ids are checked against the whole store and session folds merge in any order.
    A micro-batch is stored under the stream's name and its number, so a replayed one replaces
    what its first run left; Spark's checkpoint decides what is replayed.
    """

    def process(batch: DataFrame, number: int) -> None:
        ingest_payloads(batch, store, salt, f"{name}-{number}", services)

    return _start(payloads, process, checkpoint, trigger or {"availableNow": True})


def stream_events(
    events: DataFrame, store: EventStore, arrival: list[str], name: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Ingest a stream of sanitised canonical events."""

    def process(batch: DataFrame, number: int) -> None:
        store.append(batch, arrival, f"{name}-{number}")

    return _start(events, process, checkpoint, trigger or {"availableNow": True})


def recent_unique_events(events: DataFrame, delay: str) -> DataFrame:
    """Streaming deduplication with bounded state, for pipelines that accept a time limit.

    A copy arriving more than ``delay`` after the first one is not recognised; the store's own
    check has no such limit and stays the default. The watermark runs on the receive time.
    """
    return events.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def gate_counts_by_minute(payloads: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Accepted and rejected payloads per minute of receipt, as a watermarked stream."""
    gated = gate_payloads(payloads).select("received_at", "status")
    counts = gated.withWatermark("received_at", delay).groupBy(F.window("received_at", "1 minute"))
    return counts.agg(
        F.count_if(F.col("status") == "accepted").alias("accepted_payloads"),
        F.count_if(F.col("status") == "rejected").alias("rejected_payloads"),
    ).select(F.col("window.start").alias("minute"), "accepted_payloads", "rejected_payloads")


def write_versions(frame: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write every change of a streaming aggregate as rows of a table, with the number of its micro-batch.

    The rows with the highest number of each key are the current state.
    """

    def process(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/number={number}")

    writer = frame.writeStream.outputMode("update").foreachBatch(process)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
