"""The three end-to-end flows: live ingest, document replay, payload inspection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from sessionloom.operators.audit import audit_documents
from sessionloom.operators.gate import gate_payloads, latest_payload, reject_failed
from sessionloom.operators.logs import decode_logs, log_events
from sessionloom.operators.privacy import sanitise_column, sanitise_events
from sessionloom.operators.traces import decode_traces, rejected_documents, trace_events
from sessionloom.schemas import LOG_SERVICES
from sessionloom.sources.store import EventStore

# Arrival order of log records: by receive time, payload and position in the payload.
LOG_ARRIVAL = ["received_at", "payload_id", "record_index"]
TRACE_ARRIVAL = ["document_id", "record_index"]


def classify_payloads(payloads: DataFrame, services: Sequence[str] = LOG_SERVICES) -> DataFrame:
    """Gate payloads and normalise logs: status, codes, verdict and decoded records per payload.

    Trace payloads are accepted and counted here; only reviewed documents turn into events.
    """
    return reject_failed(decode_logs(gate_payloads(payloads), services))


def safe_log_events(classified: DataFrame, salt: bytes) -> DataFrame:
    """Sanitised canonical events of classified payloads.

    Everything up to here is narrow, so unsanitised content reaches no shuffle or disk.
    """
    return sanitise_events(log_events(classified, salt), salt)


def ingest_payloads(
    payloads: DataFrame, store: EventStore, salt: bytes, batch: str, services: Sequence[str] = LOG_SERVICES
) -> None:
    """Gate, normalise, sanitise and store one named batch of payloads.

    One pass gives all outputs: new events, the ids and codes of rejected payloads, and the numbers
    of accepted and rejected ones. A batch that is ingested again replaces its former outputs.
    """
    classified = classify_payloads(payloads, services)
    keep = ("payload_id", "signal", "error_code")
    store.append_payloads(sanitise_events(log_events(classified, salt, keep, True), salt), LOG_ARRIVAL, batch)


@dataclass(frozen=True)
class Replay:
    """Result of replaying documents: sanitised events and the rejected documents."""

    events: DataFrame
    rejected: DataFrame


def replay_documents(documents: DataFrame, salt: bytes) -> Replay:
    """Audit and normalise wrapped trace documents."""
    decoded = decode_traces(audit_documents(documents))
    return Replay(sanitise_events(trace_events(decoded), salt), rejected_documents(decoded))


def inspect_latest(payloads: DataFrame, salt: bytes) -> DataFrame:
    """The newest payload that passed the gate, sanitised, with its provenance."""
    return sanitise_column(latest_payload(gate_payloads(payloads)), "payload", salt).select(
        "payload_id", "signal", "received_at", "payload", "provenance"
    )
