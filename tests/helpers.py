"""Builders shared by the tests."""

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from sessionloom.functions.times import timestamp_to_nanos
from sessionloom.operators.canonical import to_canonical
from sessionloom.schemas import PAYLOAD_SCHEMA

SALT = bytes(range(32))


def utc(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def payloads(spark, rows, content_type="application/json", at="2026-07-28T12:00:00"):
    """rows: (payload_id, signal, body) or (payload_id, signal, content_type, body)."""
    full = [
        (row[0], row[1], row[2] if len(row) == 4 else content_type, utc(at), row[-1]) for row in rows
    ]
    return spark.createDataFrame(full, PAYLOAD_SCHEMA)


def documents(spark, bodies):
    texts = [(name, body if isinstance(body, str) else json.dumps(body)) for name, body in bodies.items()]
    return spark.createDataFrame(texts, "document_id string, body string")


def events(spark, rows):
    """rows: (event_id, session_id, event_type, time text[, model[, extensions dict]])."""
    full = [
        (at, row[0], row[1], row[2], utc(row[3]), *(row[4:] + (None, None))[:2]) for at, row in enumerate(rows)
    ]
    raw = spark.createDataFrame(
        [(*row[:6], json.dumps(row[6] or {})) for row in full],
        "ingest_seq long, id string, sid string, kind string, at timestamp, model_name string, ext string",
    )
    attributes = F.map_filter(
        F.create_map(F.lit("model"), F.col("model_name").cast("variant")), lambda key, value: value.isNotNull()
    )
    return to_canonical(
        raw,
        {
            "event_id": F.col("id"),
            "session_id": F.col("sid"),
            "event_type": F.col("kind"),
            "occurred_at": F.col("at"),
            "occurred_at_unix_nano": timestamp_to_nanos(F.col("at")),
            "received_at": F.col("at"),
            "provider": F.lit("openai"),
            "tool": F.lit("codex"),
            "source_version": F.lit("unknown"),
            "model": F.col("model_name"),
            "attributes": F.to_variant_object(attributes),
            "provider_extensions": F.parse_json("ext"),
        },
        ["ingest_seq"],
    )


def by(frame, key, *columns):
    """Collected rows of a small test frame as {key: row or single value}."""
    rows = frame.collect()
    pick = lambda row: row if not columns else row[columns[0]] if len(columns) == 1 else tuple(row[c] for c in columns)
    return {row[key]: pick(row) for row in rows}


LOG_SERVICE = {"attributes": [{"key": "service.name", "value": {"stringValue": "codex_cli_rs"}}]}


def log_payload(*records, resource=LOG_SERVICE):
    return json.dumps({"resourceLogs": [{"resource": resource, "scopeLogs": [{"logRecords": list(records)}]}]})


def pair(key, **value):
    return {"key": key, "value": value}
