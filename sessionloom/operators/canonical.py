"""The canonical event envelope both adapters end in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.schemas import (
    EVENT_SCHEMA,
    PRIVACY_LEVEL,
    SCHEMA_VERSION,
    SOURCE_SCHEMA,
    UNAVAILABLE,
)


def to_canonical(frame: DataFrame, fields: dict[str, Column], keep: list[str]) -> DataFrame:
    """Project onto the envelope, filling constants and marking unknown ids as unavailable.

    Unknown values stay NULL or ``unavailable``; they never become zero. ``keep`` names
    columns of ``frame`` that travel along after the envelope.
    """
    constants = {
        "schema_version": F.lit(SCHEMA_VERSION),
        "source_schema": F.lit(SOURCE_SCHEMA),
        "privacy_level": F.lit(PRIVACY_LEVEL),
        "actor_id": F.lit(UNAVAILABLE),
        "device_id": F.lit(UNAVAILABLE),
        "task_id": F.lit(None),
        "repository_id": F.lit(None),
        "model": F.lit(None),
    }
    columns = constants | fields
    envelope = [
        columns[field.name].cast(field.dataType).alias(field.name) for field in EVENT_SCHEMA.fields
    ]
    return frame.select(*envelope, *keep)


def unite_events(*adapters: DataFrame) -> DataFrame:
    """Events of several adapters in one frame."""
    united = adapters[0].select(*EVENT_SCHEMA.names)
    for other in adapters[1:]:
        united = united.unionByName(other.select(*EVENT_SCHEMA.names))
    return united


def event_documents(events: DataFrame) -> DataFrame:
    """Canonical events as the open JSON documents the contracts describe (one VARIANT column)."""
    members = [
        F.struct(
            F.lit(name).alias("key"),
            F.coalesce(
                F.col(name) if name in ("attributes", "provider_extensions") else _json_scalar(name),
                F.parse_json(F.lit("null")),
            ).alias("value"),
        )
        for name in EVENT_SCHEMA.names
        if name not in ("occurred_at_unix_nano", "model")
    ]
    return events.select(
        "event_id", F.to_variant_object(F.map_from_entries(F.array(*members))).alias("document")
    )


def rfc3339_text(instant: Column) -> Column:
    """UTC instant in RFC 3339 form with trailing fraction zeros dropped."""
    text = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0+\z", ""), F.lit("Z"))


def _json_scalar(name: str) -> Column:
    text = rfc3339_text(F.col(name)) if name in ("occurred_at", "received_at") else F.col(name)
    return text.cast("variant")
