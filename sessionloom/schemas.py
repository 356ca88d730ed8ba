"""Column types, fixed values and enumerations of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the canonical data model, version 0.1.0.
SCHEMA_VERSION = "0.1.0"
SOURCE_SCHEMA = "otel"
UNAVAILABLE = "unavailable"
PRIVACY_LEVEL = "operational"
PRIVACY_LEVELS = ["aggregate", "operational", "governed-content", "forensic"]
SESSION_STATES = ["created", "active", "completed", "failed", "cancelled", "abandoned", "unknown"]
TERMINAL_STATES = ["completed", "failed", "cancelled", "abandoned"]
POLICY_OUTCOMES = ["violation", "not_violation", "indeterminate"]
PROVENANCE_ACTIONS = ["retained", "removed", "hashed", "redacted"]
SUPPORTED_PROVIDER = "openai"
SUPPORTED_TOOL = "codex"
LOG_SERVICES = ["codex_cli_rs"]
DEFAULT_LOG_EVENT_TYPE = "codex.log.received"
TRACE_ID_PREFIX = "codex:"
LOG_ID_PREFIX = "codex-log:"
MAX_PAYLOAD_BYTES = 1048576
SIGNAL_FIELDS = {"traces": "resourceSpans", "logs": "resourceLogs"}
LOG_ATTRIBUTE_ALLOWLIST = ["model", "input_token_count", "output_token_count"]
SCALAR_VALUE_KEYS = ["stringValue", "intValue", "boolValue", "doubleValue"]
TRACE_UNAVAILABLE_FIELDS = [
    "model",
    "token_usage",
    "cache_usage",
    "tool_calls",
    "file_operations",
    "command_execution",
    "approvals",
    "prompt_content",
    "response_content",
    "repository_context",
    "task_outcome",
    "provider_cost",
]
LOG_UNAVAILABLE_FIELDS = [
    "session_lifecycle",
    "cache_usage",
    "reasoning_tokens",
    "tool_calls",
    "file_operations",
    "command_execution",
    "approvals",
    "prompt_content",
    "response_content",
    "repository_context",
    "task_outcome",
    "provider_cost",
]

PAYLOAD_SCHEMA = T.StructType(
    [
        T.StructField("payload_id", T.StringType(), False),
        T.StructField("signal", T.StringType(), False),
        T.StructField("content_type", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("body", T.StringType()),
    ]
)

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("document_id", T.StringType(), False),
        T.StructField("body", T.StringType()),
    ]
)

# An entry names its place by a step from the entry of the object around it, ``up`` entries before it
# (0: the step is the whole path). Paths are put together when they are read.
PROVENANCE_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("up", T.IntegerType()),
            T.StructField("step", T.StringType()),
            T.StructField("action", T.StringType()),
            T.StructField("reason", T.StringType()),
        ]
    )
)

# The 17-field envelope plus typed copies of the attributes that queries filter on,
# so that those filters reach the Parquet scan.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("occurred_at", T.TimestampType()),
        T.StructField("occurred_at_unix_nano", T.LongType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("provider", T.StringType()),
        T.StructField("tool", T.StringType()),
        T.StructField("source_schema", T.StringType()),
        T.StructField("source_version", T.StringType()),
        T.StructField("actor_id", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("task_id", T.StringType()),
        T.StructField("repository_id", T.StringType()),
        T.StructField("privacy_level", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("attributes", T.VariantType()),
        T.StructField("provider_extensions", T.VariantType()),
    ]
)

SESSION_COLUMNS = [
    "session_id",
    "schema_version",
    "provider",
    "tool",
    "state",
    "started_at",
    "completed_at",
    "event_count",
]
