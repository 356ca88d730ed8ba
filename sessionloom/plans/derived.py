"""Pipeline inputs derived from the ``events`` table, one or two rows per table row.

The table holds flat, clean rows. These views turn every one of them into the kinds of input
the pipeline meets: canonical events with copies and time ties, raw payloads and wrapped
documents with every fault the operators must recognise. The fault a row gets depends on its
id; all rows are used.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.times import timestamp_to_nanos
from sessionloom.operators.canonical import to_canonical
from sessionloom.schemas import MAX_PAYLOAD_BYTES

# A fixed salt for the registered queries; jobs pass their own secret.
QUERY_SALT = bytes(range(32))

PAYLOAD_KINDS = 12
DOCUMENT_KINDS = 20
CONTRACT_KINDS = 8
SETTINGS_KINDS = 16
ROWS_A_TASK = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """Spread rows over all cores when a small table would be read by fewer tasks.

    For tables of long texts, which are costly to shuffle: one that is already read by enough
    tasks is left as it is.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame if frame.rdd.getNumPartitions() >= cores else frame.repartition(cores)


def spread_rows(frame: DataFrame) -> DataFrame:
    """Deal the rows of a flat table evenly over tasks of at most ``ROWS_A_TASK`` rows each.

    How many tasks read a file says nothing about their rows: a row group of a million rows is read
    by one task, and the views below make a gigabyte of payloads of them. Counting reads the
    files' footers only, and the flat rows are small to shuffle.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(max(cores, -(-frame.count() // ROWS_A_TASK)))


def source_events(rows: DataFrame) -> DataFrame:
    """The events table with its time as an instant and ``k`` taken out of ``props``."""
    return rows.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _model(k: Column) -> Column:
    return F.when(k % 7 != 0, F.concat(F.lit("model-"), (k % 5).cast("string")))


def _event_type(kind: Column) -> Column:
    names = {
        "signup": "session.created",
        "view": "session.started",
        "purchase": "session.completed",
        "error": "genai.model.request.failed",
    }
    mapped = F.lit("tool.observed")
    for source, name in names.items():
        mapped = F.when(kind == source, name).otherwise(mapped)
    return mapped


def canonical_events(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    """One canonical event per row. Times are cut to the hour, so sessions have ties.

    ``even`` deals the flat rows evenly, for events that are sanitised next.
    """
    flat = table(spark, sf_dir, "events")
    rows = source_events(spread_rows(flat) if even else flat).withColumn("at", F.date_trunc("hour", "ts"))
    attributes = F.map_filter(
        F.create_map(F.lit("model"), _model(F.col("k")).cast("variant")),
        lambda name, value: value.isNotNull(),
    )
    return to_canonical(
        rows,
        {
            "event_id": F.concat(F.lit("e-"), F.col("event_id").cast("string")),
            "event_type": _event_type(F.col("event_type")),
            "occurred_at": F.col("at"),
            "occurred_at_unix_nano": timestamp_to_nanos(F.col("at")),
            "received_at": F.col("ts"),
            "provider": F.lit("openai"),
            "tool": F.concat(F.lit("tool-"), (F.col("user_id") % 3).cast("string")),
            "source_version": F.lit("unknown"),
            "session_id": F.concat(
                F.lit("s-"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")
            ),
            "model": _model(F.col("k")),
            "attributes": F.to_variant_object(attributes),
            "provider_extensions": F.parse_json(F.lit("{}")),
        },
        [],
    ).withColumn("ingest_seq", F.substring_index("event_id", "-", -1).cast("bigint"))


def arriving_events(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    """Every canonical event twice: the later copy claims another type and another session."""
    first = canonical_events(spark, sf_dir, even)
    copy = first.withColumns(
        {
            "event_type": F.lit("session.abandoned"),
            "session_id": F.concat(F.lit("copy-"), F.col("session_id")),
            "ingest_seq": F.col("ingest_seq") + F.lit(1_000_000_000_000),
        }
    )
    return first.unionByName(copy)


def fill(template: str, **values: Column) -> Column:
    """Text with every ``<name>`` in the template replaced by a column."""
    parts = re.split(r"<(\w+)>", template)
    return F.concat(
        *[values[part].cast("string") if at % 2 else F.lit(part) for at, part in enumerate(parts) if part]
    )


RECORD = (
    '{"attributes":[{"key":"event.name","value":{"stringValue":"codex.<event_type>"}},<model>'
    '{"key":"input_token_count","value":{"intValue":"<k>"}},'
    '{"key":"arguments","value":{"stringValue":"raw arguments <event_id>"}},'
    '{"key":"command.args","value":{"stringValue":"--flag <event_id>"}},'
    '{"key":"prompt","value":{"stringValue":"words <event_id>"}},'
    '{"key":"user.email","value":{"stringValue":"u<user_id>@example.test"}},'
    '{"key":"file.path","value":{"stringValue":"/home/u<user_id>/main.py"}},'
    '{"key":"flags","value":{"arrayValue":{"values":[{"boolValue":true},{"stringValue":"Infinity"}]}}},'
    '{"key":"flags","value":{"kvlistValue":{}}},'
    '{"key":"retries","value":{"doubleValue":1.5}},{"key":"retries","value":{"boolValue":false}},'
    '{"key":"empty","value":{}},{"key":"conversation.id"}],'
    '"body":{"stringValue":"text of <event_id><long>"},"severityText":"INFO","timeUnixNano":"<nanos>"}'
)
SECOND_RECORD = '{"attributes":[],"body":null,"observedTimeUnixNano":"<nanos>"}'
LOGS = (
    '{"resourceLogs":[{"resource":{"attributes":['
    '{"key":"service.name","value":{"stringValue":"<service>"}},'
    '{"key":"service.version","value":{"stringValue":"0.<k>.0"}}]},'
    '"scopeLogs":[{"scope":{"name":"otel"},"logRecords":[<records>]},{"logRecords":[]}]},'
    '{"resource":{"attributes":[]},"scopeLogs":[{"logRecords":[{"attributes":[]}]}]}]}'
)
TRACES = (
    '{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"t<user_id>","spanId":"<event_id>","name":"span"}]}]}]}'
)


def raw_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw payload per row in the payload schema, plus ``kind`` (which fault, if any)."""
    rows = source_events(spread_rows(table(spark, sf_dir, "events"))).withColumn("kind", F.col("event_id") % PAYLOAD_KINDS)
    model = F.when(F.col("k") % 7 == 0, "").otherwise(
        fill('{"key":"model","value":{"stringValue":"model-<m>"}},', m=F.col("k") % 5)
    )
    values = {
        "event_type": F.col("event_type"),
        "k": F.col("k"),
        "event_id": F.col("event_id"),
        "user_id": F.col("user_id"),
        "nanos": timestamp_to_nanos(F.col("ts")),
        "model": model,
        # A text with a number beyond the range of a double, next to a text named like one.
        "long": F.when(F.col("kind") == 1, " 1e400").otherwise(""),
    }
    record = fill(RECORD, **values)
    second = fill(SECOND_RECORD, **values)
    # Kind 8: a number where the log format has a string.
    numeric_time = F.regexp_replace(record, r'"timeUnixNano":"(\d+)"', r'"timeUnixNano":$1')
    records = (
        F.when(F.col("kind") == 1, F.concat(record, F.lit(","), second))
        .when(F.col("kind") == 8, numeric_time)
        .otherwise(record)
    )
    service = F.when(F.col("kind") == 2, "other_service").otherwise("codex_cli_rs")
    logs = fill(LOGS, service=service, k=F.col("k"), records=records)
    kind = F.col("kind")
    # Kind 11 is "null", and one in 83 of those is a text of one byte more than the limit.
    # Repeated from a column, so that the long text does not become a constant of the plan.
    blank = F.concat(F.substring("event_type", 1, 0), F.lit(" "))
    oversized = F.concat(F.lit("{}"), F.repeat(blank, MAX_PAYLOAD_BYTES - 1))
    body = (
        F.when(kind == 3, F.expr("substring(logs, 1, length(logs) - 1)"))
        .when(kind == 4, F.concat("logs", F.lit(" {}")))
        .when(kind == 5, '{"resourceLogs":[]}')
        .when(kind == 9, fill(TRACES, **values))
        .when(kind == 10, F.regexp_replace("logs", r"\}\z", ',"extra":1}'))
        .when((kind == 11) & (F.col("event_id") % (83 * PAYLOAD_KINDS) == 11), oversized)
        .when(kind == 11, "null")
        .otherwise(F.col("logs"))
    )
    content_type = (
        F.when(kind == 1, "Application/JSON; charset=utf-8")
        .when(kind == 7, "application/x-protobuf")
        .otherwise("application/json")
    )
    return rows.withColumn("logs", logs).select(
        F.concat(F.lit("p-"), F.col("event_id").cast("string")).alias("payload_id"),
        F.when(kind.isin(6, 9), "traces").otherwise("logs").alias("signal"),
        content_type.alias("content_type"),
        F.col("ts").alias("received_at"),
        body.alias("body"),
        "kind",
        F.col("event_id").alias("source_id"),
    )


DOCUMENT = (
    '{"fixture_version":<number>,"fixture_origin":"<origin>","provider":"<provider>","tool":"<tool>",<version>'
    '"captured_at":"<captured>","sanitisation_reviewed":<reviewed>,"payload":<payload>}'
)
ONE_SPAN = (
    '"resourceSpans":[{"scopeSpans":[{"spans":[{"name":"span.<event_type>","traceId":"t<user_id>",'
    '<span_id>"startTimeUnixNano":"<start>"}]}]}]'
)
TWO_SPANS = (
    '"resourceSpans":[{"region":"r<k>","scopeSpans":[{"scope":{"name":"lib"},"spans":[{"name":"span.<event_type>",'
    '"traceId":"t<user_id>","spanId":"<event_id>","startTimeUnixNano":"<start>","status":{"code":<k>}}]},'
    '{"spans":[{"name":"session.started","traceId":"t<user_id>","spanId":"<event_id>b","startTimeUnixNano":"<start>"}]}]}]'
)


def wrapped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wrapped trace document per row, plus ``kind`` (which fault, if any)."""
    rows = source_events(spread_rows(table(spark, sf_dir, "events"))).withColumn("kind", F.col("event_id") % DOCUMENT_KINDS)
    kind = F.col("kind")
    values = {
        "event_type": F.col("event_type"),
        "k": F.col("k"),
        "event_id": F.col("event_id"),
        "user_id": F.col("user_id"),
        "start": F.when(kind == 5, F.lit("0")).otherwise(timestamp_to_nanos(F.col("ts")).cast("string")),
        "span_id": F.when(kind == 4, "").otherwise(fill('"spanId":"<id>",', id=F.col("event_id"))),
    }
    payload = (
        F.when(kind == 1, fill(TWO_SPANS, **values))
        .when(kind == 6, '"resourceSpans":[{"scopeSpans":[{"spans":[]}]}]')
        .when(kind == 7, F.concat(fill(ONE_SPAN, **values), F.lit(',"notes":[{"Source-Code":1}]')))
        .when(kind == 8, F.concat(fill(ONE_SPAN, **values), F.lit(',"note":"bearer abcdefghijkl.0"')))
        # Two faults; the first one in the order of keys counts.
        .when(kind == 17, F.concat(fill(ONE_SPAN, **values), F.lit(',"c":{"token":1},"b":[{"x":"sk-abcdefghijklmnop"}]')))
        .otherwise(fill(ONE_SPAN, **values))
    )
    body = fill(
        DOCUMENT,
        number=F.when(kind == 11, "2").otherwise("1"),
        origin=F.when(kind == 12, "live").otherwise("synthetic"),
        provider=F.when(kind == 3, "other").when(kind == 13, "  ").otherwise("openai"),
        tool=F.when(kind == 14, "other").when(kind == 18, "").otherwise("codex"),
        version=F.when(kind == 2, "")
        .when(kind == 19, '"tool_version":" ",')
        .otherwise(fill('"tool_version":"v<k>",', k=F.col("k"))),
        reviewed=F.when(kind == 15, "false").otherwise("true"),
        captured=F.when(kind == 10, F.lit("2024-01-01 00:00:00")).otherwise(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
        ),
        payload=F.when(kind == 16, "[]").otherwise(F.concat(F.lit("{"), payload, F.lit("}"))),
    )
    return rows.select(
        F.concat(F.lit("d-"), F.col("event_id").cast("string")).alias("document_id"),
        F.when(kind == 9, F.concat(body, F.lit("}"))).otherwise(body).alias("body"),
        "kind",
    )


EVENT_DOCUMENT = (
    '{"schema_version":"<schema>","event_id":"e-<event_id>","event_type":"<event_type>",'
    '"occurred_at":"2024-01-01T00:00:00Z","received_at":"2024-01-01T00:00:01Z",<provider>"tool":"<tool>",'
    '"source_schema":"otel","source_version":"unknown","actor_id":"unavailable","device_id":"unavailable",'
    '"session_id":"s-<user_id>","task_id":<task>,"repository_id":null,"privacy_level":"<level>",'
    '"attributes":<attributes>,"provider_extensions":{"vendor":{"shard":4}}<extra>}'
)
SETTINGS_DOCUMENT = (
    '{"schema_version":"<schema>","mode":"<mode>","collection":{"level":"<level>","prompts":<prompts>,'
    '"responses":<responses>,"source_code":<source>,"file_paths":"<paths>","command_arguments":"<arguments>",'
    '"tool_calls":true,"model_usage":true},"storage":{"destination":"<destination>","retention_days":<days>},'
    '"sharing":{"diagnostics":<diagnostics>,"anonymous_analytics":<anonymous>,"research_sessions":"<research>"<extra>}}'
)
POLICY_DOCUMENT = (
    '{"schema_version":"0.1.0","policy_id":"<policy>","policy_version":"1.<k>.0","outcome":"<outcome>",'
    '"evidence":[{"kind":"check","reference":"pipeline-<k>"}<evidence>]}'
)


def contract_documents(spark: SparkSession, sf_dir: str, contract: str) -> DataFrame:
    """One event, settings or policy document per row with planted contract faults."""
    kinds = SETTINGS_KINDS if contract == "settings" else CONTRACT_KINDS
    rows = source_events(spread_rows(table(spark, sf_dir, "events"))).withColumn("kind", F.col("event_id") % kinds)
    kind = F.col("kind")

    def either(number: int, faulty: str, sound: str) -> Column:
        return F.when(kind == number, faulty).otherwise(sound)

    ids = {"event_id": F.col("event_id"), "user_id": F.col("user_id"), "k": F.col("k")}
    if contract == "event":
        body = fill(
            EVENT_DOCUMENT,
            **ids,
            event_type=F.col("event_type"),
            schema=either(1, "0.2.0", "0.1.0"),
            provider=either(2, "", '"provider":"openai",'),
            tool=either(3, "", "codex"),
            task=either(4, "7", "null"),
            level=either(5, "secret", "operational"),
            attributes=either(6, "[]", "{}"),
            extra=either(7, ',"prompt_text":"x","cost":1', ""),
        )
    elif contract == "settings":
        body = fill(
            SETTINGS_DOCUMENT,
            schema=either(8, "0.2.0", "0.1.0"),
            responses=either(9, "true", "false"),
            source=either(10, "true", "false"),
            arguments=either(11, "keep", "redact"),
            destination=either(12, "remote", "local"),
            diagnostics=either(13, "true", "false"),
            research=either(14, "always", "explicit-only"),
            mode=either(1, "cloud", "local-only"),
            level=either(2, "forensic", "operational"),
            prompts=either(3, "true", "false"),
            paths=F.when(kind.isin(3, 4), "raw").otherwise("hash"),
            days=F.when(kind == 5, F.lit(0)).otherwise(F.col("k") + 1),
            anonymous=either(6, '"no"', "false"),
            extra=either(7, ',"upload":true', ""),
        )
    else:
        body = fill(
            POLICY_DOCUMENT,
            k=F.col("k"),
            policy=either(1, "", "review-before-merge"),
            outcome=either(2, "unknown", "indeterminate"),
            evidence=F.when(kind == 3, ',{"kind":"check"}')
            .when(kind == 4, ',{"kind":"check","reference":"x","value":1}')
            .otherwise(""),
        )
    return rows.select("event_id", "kind", F.parse_json(body).alias("document"))
