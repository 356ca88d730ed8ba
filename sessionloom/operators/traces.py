"""Trace adapter: reviewed trace documents become canonical events, one per span.

A document is normalised as a whole or not at all. The verdict comes from the document's own
nested arrays, so neither an explode-and-regroup nor a self-join is needed to find it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.evaluate import evaluate_once
from sessionloom.functions.times import nanos_to_timestamp, parse_rfc3339, parse_unix_nanos
from sessionloom.functions.variants import (
    as_array,
    as_object,
    bind,
    member,
    not_blank,
    string_or_null,
)
from sessionloom.operators.canonical import to_canonical
from sessionloom.schemas import (
    SUPPORTED_PROVIDER,
    SUPPORTED_TOOL,
    TRACE_ID_PREFIX,
    TRACE_UNAVAILABLE_FIELDS,
)

SPAN_KEYS = ["traceId", "spanId", "name", "startTimeUnixNano"]
_SPAN_TYPES = {
    "error_path": "string",
    "error_code": "string",
    "trace_id": "string",
    "span_id": "string",
    "name": "string",
    "start_nano": "bigint",
    "resource_rest": "variant",
    "scope_rest": "variant",
    "span_rest": "variant",
}


def _span_row(**known: Column) -> Column:
    return F.struct(
        *[
            known.get(name, F.lit(None)).cast(dtype).alias(name)
            for name, dtype in _SPAN_TYPES.items()
        ]
    )


def _failure(path: Column, code: str) -> Column:
    return F.array(_span_row(error_path=path, error_code=F.lit(code)))


def _rest(members: Column, known: Sequence[str]) -> Column:
    """The members of an object that the adapter does not know, as an object."""
    return F.to_variant_object(F.map_filter(members, lambda key, value: ~key.isin(list(known))))


def _span(value: Column, path: Column, resource_rest: Column, scope_rest: Column) -> Column:
    read = F.struct(
        as_object(value).alias("members"),
        *[string_or_null(member(value, key)).alias(key) for key in SPAN_KEYS],
        parse_unix_nanos(string_or_null(member(value, "startTimeUnixNano"))).alias("nano"),
    )

    def judged(span: Column) -> Column:
        bad_key = F.coalesce(
            *[F.when(~not_blank(span[key]), key) for key in SPAN_KEYS],
            F.when(span["nano"].isNull(), "startTimeUnixNano"),
        )
        is_object = span["members"].isNotNull()
        return _span_row(
            error_path=F.when(~is_object, path).otherwise(F.concat(path, F.lit("."), bad_key)),
            error_code=F.when(~is_object, "not_an_object").when(
                bad_key.isNotNull(), "invalid_span_field"
            ),
            trace_id=span["traceId"],
            span_id=span["spanId"],
            name=span["name"],
            start_nano=span["nano"],
            resource_rest=resource_rest,
            scope_rest=scope_rest,
            span_rest=_rest(span["members"], SPAN_KEYS),
        )

    return bind(read, judged)


def _level(value: Column, path: Column, name: str, per_item) -> Column:
    """Rows of the items in list ``name`` of an object, or one failure row.

    ``per_item`` maps (item, path) to an array of span rows.
    """
    items = as_array(member(value, name))
    list_path = F.concat(path, F.lit(f".{name}"))
    item_path = lambda index: F.concat(list_path, F.lit("["), index.cast("string"), F.lit("]"))
    return (
        F.when(as_object(value).isNull(), _failure(path, "not_an_object"))
        .when(F.coalesce(F.size(items), F.lit(0)) < 1, _failure(list_path, "not_a_filled_array"))
        .otherwise(
            F.flatten(F.transform(items, lambda item, index: per_item(item, item_path(index))))
        )
    )


def _document_spans(payload: Column) -> Column:
    # What a resource or scope keeps beside its list is taken once, not once per span below it.
    def scopes(resource: Column, path: Column) -> Column:
        return bind(
            _rest(as_object(resource), ["scopeSpans"]),
            lambda resource_rest: _level(
                resource,
                path,
                "scopeSpans",
                lambda scope, scope_path: spans(scope, scope_path, resource_rest),
            ),
        )

    def spans(scope: Column, path: Column, resource_rest: Column) -> Column:
        return bind(
            _rest(as_object(scope), ["spans"]),
            lambda scope_rest: _level(
                scope,
                path,
                "spans",
                lambda span, span_path: F.array(_span(span, span_path, resource_rest, scope_rest)),
            ),
        )

    return _level(payload, F.lit("payload"), "resourceSpans", scopes)


def decode_traces(
    documents: DataFrame,
    providers: Sequence[tuple[str, str]] = ((SUPPORTED_PROVIDER, SUPPORTED_TOOL),),
) -> DataFrame:
    """Add ``trace_error`` (path, code; NULL when fine) and ``spans`` to audited documents.

    Expects the columns of :func:`sessionloom.operators.audit.audit_documents`. A document
    that failed the audit keeps that violation as its error; a clean one that is deeper or larger
    than a VARIANT can be is ``beyond_parser_limits``.
    """
    document = F.col("document")
    pair_ok = F.lit(False)
    for provider, tool in providers:
        pair_ok = pair_ok | (
            (string_or_null(member(document, "provider")) == provider)
            & (string_or_null(member(document, "tool")) == tool)
        )
    walked = F.when(F.col("violation").isNull() & pair_ok, _document_spans(member(document, "payload")))
    rows = evaluate_once(documents, {"_rows": walked})
    first_bad = F.get(F.filter("_rows", lambda row: row["error_code"].isNotNull()), F.lit(0))
    error = (
        F.when(F.col("violation").isNotNull(), F.col("violation"))
        .when(F.col("document").isNull(), _error(F.lit(""), F.lit("beyond_parser_limits")))
        .when(F.col("_rows").isNull(), _error(F.lit("provider"), F.lit("unsupported_provider")))
        .otherwise(
            bind(
                first_bad,
                lambda bad: F.when(bad.isNotNull(), _error(bad["error_path"], bad["error_code"])),
            )
        )
    )
    return (
        evaluate_once(rows, {"trace_error": error})
        .withColumn("spans", F.when(F.col("trace_error").isNull(), F.col("_rows")))
        .drop("_rows")
    )


def _error(path: Column, code: Column) -> Column:
    return F.struct(path.alias("path"), code.alias("code"))


def rejected_documents(decoded: DataFrame) -> DataFrame:
    """Documents that yield no events, with the path and code of their first error."""
    return decoded.filter(F.col("trace_error").isNotNull()).select(
        "document_id",
        F.col("trace_error.path").alias("error_path"),
        F.col("trace_error.code").alias("error_code"),
    )


def trace_events(decoded: DataFrame) -> DataFrame:
    """Canonical events of decoded documents, with ``document_id`` and ``record_index``."""
    document = F.col("document")
    exploded = decoded.select(
        "document_id",
        string_or_null(member(document, "provider")).alias("provider"),
        string_or_null(member(document, "tool")).alias("tool"),
        string_or_null(member(document, "tool_version")).alias("tool_version"),
        parse_rfc3339(string_or_null(member(document, "captured_at"))).alias("captured_at"),
        F.posexplode_outer("spans").alias("record_index", "span"),
    ).filter(F.col("span").isNotNull())
    trace = F.concat(F.lit(TRACE_ID_PREFIX), F.col("span.trace_id"))
    attributes = F.struct(
        F.array(*[F.lit(name) for name in TRACE_UNAVAILABLE_FIELDS]).alias("unavailable_fields")
    )
    extensions = F.struct(
        F.col("span.resource_rest").alias("resource"),
        F.col("span.scope_rest").alias("scope"),
        F.col("span.span_rest").alias("span"),
    )
    return to_canonical(
        exploded,
        {
            "event_id": F.concat_ws(":", trace, F.col("span.span_id")),
            "session_id": trace,
            "event_type": F.col("span.name"),
            "occurred_at": nanos_to_timestamp(F.col("span.start_nano")),
            "occurred_at_unix_nano": F.col("span.start_nano"),
            "received_at": F.col("captured_at"),
            "provider": F.col("provider"),
            "tool": F.col("tool"),
            "source_version": F.col("tool_version"),
            "attributes": F.to_variant_object(attributes),
            "provider_extensions": F.to_variant_object(extensions),
        },
        ["document_id", "record_index"],
    )
