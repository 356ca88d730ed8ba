"""Payload gate: every raw payload ends as accepted, or rejected with one stable code.

The checks are ordered and the first failing one decides. All of them are narrow column
expressions, and a body is parsed only after the cheap checks passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.evaluate import evaluate_once
from sessionloom.functions.variants import as_object, single_json
from sessionloom.schemas import MAX_PAYLOAD_BYTES, SIGNAL_FIELDS
from sessionloom.session import require_settings

# Error codes and the HTTP status that belongs to each.
ERROR_STATUS = {
    "unsupported_media_type": 415,
    "payload_too_large": 413,
    "malformed_payload": 400,
    "invalid_payload": 400,
    "normalization_failed": 422,
}
# Nested deeper than the parser reads; such a payload is not called malformed.
ERROR_STATUS["beyond_parser_limits"] = 422
ACCEPTED_STATUS = 202
PARSER_DEPTH = 1_000


# A media type with parameters: name=token or name="quoted text", white space is blank or tab.
_TOKEN = r"[!#$%&'*+.^_`|~0-9A-Za-z-]+"
_PARAMETER = rf'[ \t]*;[ \t]*({_TOKEN})=({_TOKEN}|"(?:[^"\\]|\\.)*")'
_JSON_TYPE = rf"\A[ \t]*(?i:application/json)(?:{_PARAMETER})*[ \t]*(?:;[ \t]*)?\z"


def _media_type_ok(content_type: Column) -> Column:
    """True for JSON with well-formed parameters; a name may repeat only with an equal value."""
    names = F.transform(F.regexp_extract_all(content_type, F.lit(_PARAMETER), F.lit(1)), F.lower)
    values = F.transform(
        F.regexp_extract_all(content_type, F.lit(_PARAMETER), F.lit(2)),
        lambda value: F.regexp_replace(F.regexp_replace(value, r'\A"|"\z', ""), r"\\(.)", "$1"),
    )
    settings = F.array_distinct(F.arrays_zip(names.alias("name"), values.alias("value")))
    unique = F.size(settings) == F.size(F.array_distinct(names))
    no_parameters = ~content_type.contains(";")
    return F.coalesce(content_type.rlike(_JSON_TYPE) & (no_parameters | unique), F.lit(False))


def _has_resources(payload: Column, signal: Column) -> Column:
    """True for a payload with exactly one key, that of the signal, and a filled array below it."""
    members = as_object(payload)
    expected = F.lit(None).cast("string")
    for name, field in SIGNAL_FIELDS.items():
        expected = F.when(signal == name, field).otherwise(expected)
    first = F.when(F.size(members) == 1, F.try_variant_get(F.try_element_at(members, expected), "$[0]", "variant"))
    return first.isNotNull()


def _too_deep(body: Column) -> Column:
    """True for a text whose brackets close and are nested deeper than the parser reads.

    Meant for bodies that the parser has refused; only those with enough brackets are looked at.
    """
    opening = F.length(body) - F.length(F.translate(body, "{[", ""))
    brackets = F.regexp_replace(F.regexp_replace(body, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]+", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(depth: Column, mark: Column) -> Column:
        now = depth["now"] + F.when(mark.isin("{", "["), 1).when(mark.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(depth["most"], now).alias("most"))

    closes = lambda depth: (depth["now"] == 0) & (depth["most"] >= PARSER_DEPTH)
    # Short bodies are not counted: so many brackets that close take twice as many bytes.
    long = F.octet_length(body) >= 2 * PARSER_DEPTH
    return F.when(long & (opening >= PARSER_DEPTH), F.aggregate(F.split(brackets, ""), start, step, closes)).otherwise(False)


def gate_payloads(payloads: DataFrame) -> DataFrame:
    """Add ``payload`` (VARIANT), ``status``, ``error_code`` and ``http_status``.

    Needs the columns ``signal``, ``content_type`` and ``body``; other columns pass through.
    ``payload`` is NULL for rejected rows.
    """
    require_settings(payloads.sparkSession)
    typed = evaluate_once(payloads, {"_json": _media_type_ok(F.col("content_type"))})
    fits = F.col("_json") & (F.octet_length("body") <= MAX_PAYLOAD_BYTES)
    parsed = evaluate_once(typed, {"_parsed": F.when(fits, single_json(F.col("body")))})
    value = F.col("_parsed")
    # A body that is one JSON value is an object when it begins like one; a cast would copy the value.
    begins_object = F.col("body").rlike(r"\A[ \t\r\n]*\{")
    malformed = value.isNull() | (~begins_object & ~F.is_variant_null(value))
    code = (
        F.when(~F.col("_json"), "unsupported_media_type")
        .when(F.octet_length("body") > MAX_PAYLOAD_BYTES, "payload_too_large")
        .when(value.isNull() & _too_deep(F.col("body")), "beyond_parser_limits")
        .when(malformed, "malformed_payload")
        .when(~_has_resources(value, F.col("signal")), "invalid_payload")
    )
    coded = evaluate_once(parsed, {"error_code": code})
    return _with_status(coded, F.col("_parsed")).drop("_parsed", "_json")


def _with_status(coded: DataFrame, payload: Column) -> DataFrame:
    http_status = F.lit(ACCEPTED_STATUS)
    for name, number in ERROR_STATUS.items():
        http_status = F.when(F.col("error_code") == name, number).otherwise(http_status)
    return coded.withColumns(
        {
            "status": F.when(F.col("error_code").isNull(), "accepted").otherwise("rejected"),
            "http_status": http_status,
            "payload": F.when(F.col("error_code").isNull(), payload),
        }
    )


def reject_failed(gated: DataFrame, verdict: str = "log_verdict") -> DataFrame:
    """Turn accepted payloads whose normalisation failed into ``normalization_failed``."""
    failed = F.col("error_code").isNull() & F.coalesce(F.col(verdict) == "failed", F.lit(False))
    code = F.when(failed, "normalization_failed").otherwise(F.col("error_code"))
    return _with_status(gated.withColumn("error_code", code), F.col("payload"))


def gate_counters(gated: DataFrame) -> DataFrame:
    """One row with the number of accepted and rejected payloads."""
    return gated.agg(
        F.count_if(F.col("status") == "accepted").alias("accepted_payloads"),
        F.count_if(F.col("status") == "rejected").alias("rejected_payloads"),
    )


def latest_payload(gated: DataFrame) -> DataFrame:
    """The newest payload that passed the gate, still unsanitised; at most one row.

    Every task reduces its rows to one candidate, so payloads are neither sorted nor shuffled. Of
    equal times the greatest payload id counts; a payload without time is the oldest.
    """
    passed = gated.filter(F.col("payload").isNotNull())
    row = F.struct(*[F.col(name) for name in gated.columns])
    order = F.struct("received_at", "payload_id")
    newest = passed.agg(F.max_by(row, order).alias("newest"))
    return newest.filter(F.col("newest").isNotNull()).select("newest.*")
