"""Log adapter: accepted log payloads become canonical events, one per log record.

Decoding, type checks and flattening are one narrow projection per payload; nothing is
shuffled. Record order inside a payload is kept in ``record_index``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.evaluate import evaluate_once
from sessionloom.functions.hashing import fingerprint
from sessionloom.functions.times import timestamp_to_nanos
from sessionloom.functions.variants import (
    absent,
    as_object,
    bind,
    is_string,
    member,
    string_or_null,
)
from sessionloom.operators.canonical import to_canonical
from sessionloom.schemas import (
    DEFAULT_LOG_EVENT_TYPE,
    LOG_ATTRIBUTE_ALLOWLIST,
    LOG_ID_PREFIX,
    LOG_SERVICES,
    LOG_UNAVAILABLE_FIELDS,
    SCALAR_VALUE_KEYS,
    SUPPORTED_PROVIDER,
    SUPPORTED_TOOL,
    UNAVAILABLE,
)
from sessionloom.session import require_settings


# What the adapter reads of a log payload. Members that must be strings, and attribute values,
# are read as VARIANT because a string column would silently accept numbers.
_PAIRS = "array<struct<key:variant,value:variant>>"
_LOG_TREE = (
    f"resourceLogs array<struct<resource:struct<attributes:{_PAIRS}>,"
    f"scopeLogs:array<struct<logRecords:array<struct<attributes:{_PAIRS},body:variant,"
    "observedTimeUnixNano:variant,severityText:variant,timeUnixNano:variant>>>>>>, "
    "_mistyped string"
)
# Record bodies once more as the text they were received as, for the identity of a record.
_BODY_TREE = "resourceLogs array<struct<scopeLogs:array<struct<logRecords:array<struct<body:string>>>>>>"


def _string_ok(value: Column) -> Column:
    return absent(value) | is_string(value)


def _every(items: Column, check) -> Column:
    """True when every item passes; a missing list passes."""
    return F.coalesce(F.forall(items, check), F.lit(True))


def _pairs_ok(pairs: Column) -> Column:
    return _every(
        pairs,
        lambda pair: _string_ok(pair["key"])
        & (absent(pair["value"]) | as_object(pair["value"]).isNotNull()),
    )


# A number beyond the range of a double has at least 200 digits or an exponent of three.
_LONG_NUMBER = r"[eE][+]?[0-9]{3}|[0-9]{200}"
_BEYOND = '"-?Infinity"(?!:)'


def _letter_or_escape(letter: str) -> str:
    code = "".join(f"[{digit}{digit.upper()}]" if digit.isalpha() else digit for digit in f"{ord(letter):02x}")
    return rf"(?:{letter}|\\u00{code})"


# The JSON string that reads like such a number once the value is written out, escapes included.
_SAME_TEXT = '"' + _letter_or_escape("-") + "?" + "".join(_letter_or_escape(letter) for letter in "Infinity") + '"'


def _beyond_double(resources: Column) -> Column:
    """True when an attribute value holds, at any depth, a number beyond the range of a double.

    A written value shows such a number as a text; the body it is parsed from must not hold that
    text itself.
    """

    def pairs_beyond(pairs: Column) -> Column:
        return F.exists(_filled(pairs), lambda pair: F.coalesce(F.to_json(pair["value"]).rlike(_BEYOND), F.lit(False)))

    def resource_beyond(resource: Column) -> Column:
        in_records = F.exists(_records(resource), lambda record: pairs_beyond(record["attributes"]))
        return pairs_beyond(resource["resource"]["attributes"]) | in_records

    return F.exists(_filled(resources), resource_beyond)


def _record_ok(record: Column) -> Column:
    return (
        _pairs_ok(record["attributes"])
        & _string_ok(record["observedTimeUnixNano"])
        & _string_ok(record["severityText"])
        & _string_ok(record["timeUnixNano"])
    )


def _resource_ok(resource: Column) -> Column:
    scopes_ok = _every(
        resource["scopeLogs"], lambda scope: _every(scope["logRecords"], _record_ok)
    )
    return _pairs_ok(resource["resource"]["attributes"]) & scopes_ok


def _filled(items: Column) -> Column:
    """The items of a list, none when it is missing."""
    return F.coalesce(items, F.array())


def attribute_pairs(pairs: Column) -> Column:
    """Attribute list as ``ARRAY<STRUCT<key STRING, value VARIANT>>`` in its own order; NULL if missing."""
    return F.transform(
        pairs,
        lambda pair: F.struct(
            F.coalesce(string_or_null(pair["key"]), F.lit("")).alias("key"),
            F.when(~absent(pair["value"]), pair["value"]).alias("value"),
        ),
    )


def attribute_map(pairs: Column) -> Column:
    """Attribute pairs as ``MAP<STRING, VARIANT>``.

    A pair's value is the first typed scalar present, else the whole value object; pairs with
    an empty value are skipped. Among equal names the last scalar wins and a complex value
    only counts when there is no scalar, the first complex one winning.
    """

    def read(pair: Column) -> Column:
        """The pair with its scalar and, for want of one, its whole value if it is not empty."""
        scalar = F.coalesce(*[member(pair["value"], name) for name in SCALAR_VALUE_KEYS])
        return bind(
            scalar,
            lambda found: F.struct(
                pair["key"].alias("key"),
                found.alias("scalar"),
                F.when(found.isNull() & (F.size(as_object(pair["value"])) > 0), pair["value"]).alias("whole"),
            ),
        )

    def entries(read_pairs: Column, part: str) -> Column:
        return F.transform(
            F.filter(read_pairs, lambda pair: pair[part].isNotNull()),
            lambda pair: F.struct(pair["key"].alias("key"), pair[part].alias("value")),
        )

    # Later entries win (spark.sql.mapKeyDedupPolicy = LAST_WIN).
    return bind(
        F.transform(pairs, read),
        lambda done: F.map_from_entries(F.concat(F.reverse(entries(done, "whole")), entries(done, "scalar"))),
    )


def _record(record: Column, body_text: Column) -> Column:
    def text(name: str) -> Column:
        return F.coalesce(string_or_null(record[name]), F.lit(""))

    return F.struct(
        attribute_pairs(record["attributes"]).alias("attributes"),
        F.when(~absent(record["body"]), record["body"]).alias("body"),
        text("observedTimeUnixNano").alias("observedTimeUnixNano"),
        text("severityText").alias("severityText"),
        text("timeUnixNano").alias("timeUnixNano"),
        F.when(~absent(record["body"]), body_text).alias("body_text"),
    )


def _records(resource: Column) -> Column:
    return F.flatten(F.transform(_filled(resource["scopeLogs"]), lambda scope: _filled(scope["logRecords"])))


def _resource(resource: Column, bodies: Column) -> Column:
    return F.struct(
        attribute_map(_filled(attribute_pairs(resource["resource"]["attributes"]))).alias("attributes"),
        _records(resource).alias("records"),
        F.transform(_records(bodies), lambda record: record["body"]).alias("body_texts"),
    )


def _text_or(value: Column, fallback: str) -> Column:
    text = string_or_null(value)
    return F.when(text != "", text).otherwise(fallback)


def decode_logs(payloads: DataFrame, services: Sequence[str] = LOG_SERVICES) -> DataFrame:
    """Add ``log_verdict`` and ``log_records`` to gated payloads.

    The verdict is ``normalised``, ``unsupported`` (accepted, but no record of an allowed
    service) or ``failed`` (a field has the wrong type anywhere in the payload); it is NULL
    for payloads that are not accepted log payloads.
    """
    require_settings(payloads.sparkSession)
    is_log = (F.col("signal") == "logs") & F.col("payload").isNotNull()
    options = {"columnNameOfCorruptRecord": "_mistyped"}
    # Bodies with a long number, which are rare, are parsed once more without the text of one.
    suspect = F.when(is_log & F.col("body").rlike(_LONG_NUMBER), F.regexp_replace("body", _SAME_TEXT, '""'))
    tree = evaluate_once(
        payloads,
        {
            "_tree": F.from_json(F.when(is_log, F.col("body")), _LOG_TREE, options),
            "_bodies": F.from_json(F.when(is_log, F.col("body")), _BODY_TREE),
            "_beyond": _beyond_double(F.from_json(suspect, _LOG_TREE)["resourceLogs"]),
        },
    )
    mistyped = (
        F.col("_tree._mistyped").isNotNull() | ~_every(F.col("_tree.resourceLogs"), _resource_ok) | F.col("_beyond")
    )

    def supported(resource: Column) -> Column:
        service = string_or_null(F.try_element_at(resource["attributes"], F.lit("service.name")))
        return F.coalesce(service.isin(list(services)), F.lit(False))

    def with_resource(resource: Column) -> Column:
        return F.transform(
            resource["records"],
            lambda record, at: F.struct(
                resource["attributes"].alias("resource_attributes"),
                _record(record, F.get(resource["body_texts"], at)).alias("record"),
            ),
        )

    resources = F.filter(
        F.transform(
            F.col("_tree.resourceLogs"),
            lambda resource, at: _resource(resource, F.get(F.col("_bodies.resourceLogs"), at)),
        ),
        supported,
    )
    outcome = F.struct(
        mistyped.alias("failed"), F.flatten(F.transform(resources, with_resource)).alias("records")
    )
    decoded = evaluate_once(tree, {"_outcome": F.when(is_log, outcome)}).drop("_tree", "_bodies", "_beyond")
    verdict = (
        F.when(F.col("_outcome").isNull(), F.lit(None))
        .when(F.col("_outcome.failed"), "failed")
        .when(F.size("_outcome.records") == 0, "unsupported")
        .otherwise("normalised")
    )
    return (
        decoded.withColumn("log_verdict", verdict)
        .withColumn(
            "log_records", F.when(F.col("log_verdict") == "normalised", F.col("_outcome.records"))
        )
        .drop("_outcome")
    )


def _identity(record: Column) -> Column:
    """What the fingerprint covers: the record without its body as JSON, then the body's kind and text."""
    envelope = F.struct(
        *[record[name].alias(name) for name in ("attributes", "observedTimeUnixNano", "severityText", "timeUnixNano")]
    )
    kind = F.when(is_string(record["body"]), "\ntext:").otherwise("\njson:")
    return F.concat(F.to_json(envelope), F.coalesce(F.concat(kind, record["body_text"]), F.lit("")))


def log_events(
    decoded: DataFrame, salt: bytes, keep: Sequence[str] = ("payload_id",), every_payload: bool = False
) -> DataFrame:
    """Canonical events of decoded payloads, unsanitised, with ``record_index``.

    With ``every_payload`` a payload without events has one row, without ``event_id`` and
    ``record_index``.

    The identity of a record is a keyed fingerprint over its attributes, times and severity and
    the body's text as received, so identical records collapse to one event when they are stored.
    A missing attribute list differs from an empty one, a string body from the same other text.
    """
    # explode_outer keeps the optimizer from evaluating the decoded column a second time in an
    # inferred "array is not empty" filter.
    exploded = decoded.select(
        *keep, "received_at", F.posexplode_outer("log_records").alias("record_index", "entry")
    )
    found = F.col("entry").isNotNull()
    if not every_payload:
        exploded = exploded.filter(found)
    typed = exploded.select(
        *keep,
        "received_at",
        "record_index",
        F.col("entry.resource_attributes").alias("resource"),
        F.col("entry.record.severityText").alias("severity"),
        attribute_map(_filled(F.col("entry.record.attributes"))).alias("fields"),
        F.when(
            found, F.concat(F.lit(LOG_ID_PREFIX), fingerprint(_identity(F.col("entry.record")), salt))
        ).alias("record_key"),
    )
    unavailable = F.create_map(
        F.lit("unavailable_fields"),
        F.to_variant_object(F.array(*[F.lit(name) for name in LOG_UNAVAILABLE_FIELDS])),
    )
    allowed = F.map_filter("fields", lambda name, value: name.isin(LOG_ATTRIBUTE_ALLOWLIST))
    extensions = F.struct(
        F.col("resource").alias("resource_attributes"),
        F.col("fields").alias("log_attributes"),
        F.col("severity").alias("severity"),
    )

    def attribute(source: str, name: str) -> Column:
        return F.try_element_at(F.col(source), F.lit(name))

    return to_canonical(
        typed,
        {
            "event_id": F.col("record_key"),
            "session_id": F.col("record_key"),
            "event_type": _text_or(attribute("fields", "event.name"), DEFAULT_LOG_EVENT_TYPE),
            "occurred_at": F.col("received_at"),
            "occurred_at_unix_nano": timestamp_to_nanos(F.col("received_at")),
            "received_at": F.col("received_at"),
            "provider": F.lit(SUPPORTED_PROVIDER),
            "tool": F.lit(SUPPORTED_TOOL),
            "source_version": _text_or(attribute("resource", "service.version"), UNAVAILABLE),
            "model": string_or_null(attribute("fields", "model")),
            "attributes": F.to_variant_object(F.map_concat(unavailable, allowed)),
            "provider_extensions": F.to_variant_object(extensions),
        },
        [*keep, "record_index"],
    )
