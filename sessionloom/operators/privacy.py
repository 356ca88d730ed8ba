"""Privacy boundary: remove, hash or redact sensitive fields and record every decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.json_walk import provenance_paths, sanitiser
from sessionloom.schemas import EVENT_SCHEMA

# The envelope of a canonical event in key order. All its names are retained.
ENVELOPE_FIELDS = [
    "actor_id",
    "attributes",
    "device_id",
    "event_id",
    "event_type",
    "occurred_at",
    "privacy_level",
    "provider",
    "provider_extensions",
    "received_at",
    "repository_id",
    "schema_version",
    "session_id",
    "source_schema",
    "source_version",
    "task_id",
    "tool",
]
OPEN_FIELDS = ["attributes", "provider_extensions"]


def _safe(column: str, salt: bytes, prefix: str = ""):
    return sanitiser(salt)(F.to_json(F.col(column)), F.lit(prefix))


def sanitise_column(frame: DataFrame, column: str, salt: bytes) -> DataFrame:
    """Replace a VARIANT column by its safe value and add its ``provenance``."""
    walked = frame.withColumn("_safe", _safe(column, salt))
    return walked.withColumns(
        {column: F.parse_json("_safe.value"), "provenance": F.col("_safe.provenance")}
    ).drop("_safe")


def sanitise_events(events: DataFrame, salt: bytes) -> DataFrame:
    """Sanitise whole canonical events and add their ``provenance``.

    Only the two open objects are walked; their rows are merged with the constant rows of the
    envelope in key order. Hashing is not idempotent: apply this once, on the way into the store.
    """
    walked = events.withColumns({f"_{name}": _safe(name, salt, name) for name in OPEN_FIELDS})
    parts, run = [], []
    for name in ENVELOPE_FIELDS:
        run.append(
            F.struct(
                F.lit(0).alias("up"),
                F.lit(name).alias("step"),
                F.lit("retained").alias("action"),
                F.lit("operational_metadata").alias("reason"),
            )
        )
        if name in OPEN_FIELDS:
            parts += [F.array(*run), F.col(f"_{name}.provenance")]
            run = []
    parts.append(F.array(*run))
    safe = {name: F.parse_json(f"_{name}.value") for name in OPEN_FIELDS}
    envelope = [safe.get(name, F.col(name)).alias(name) for name in EVENT_SCHEMA.names]
    others = [F.col(name) for name in events.columns if name not in EVENT_SCHEMA.names]
    return walked.select(*envelope, *others, F.concat(*parts).alias("provenance"))


def provenance_rows(sanitised: DataFrame, *keys: str) -> DataFrame:
    """One row per provenance entry with its position and whole path, next to the key columns."""
    # Only what makes up the paths goes through Python; actions and reasons stay where they are.
    listed = sanitised.select(*keys, "provenance", provenance_paths("provenance.up", "provenance.step").alias("path"))
    entries = F.arrays_zip(
        F.col("path"), F.col("provenance.action").alias("action"), F.col("provenance.reason").alias("reason")
    )
    return listed.select(*keys, F.posexplode(entries).alias("ord", "entry")).select(
        *keys, "ord", "entry.path", "entry.action", "entry.reason"
    )
