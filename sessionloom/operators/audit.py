"""Review audit of wrapped documents: metadata rules, prohibited names, likely secrets.

Violations name a path and a rule, never the offending value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.evaluate import evaluate_once
from sessionloom.functions.json_scan import document_scanner
from sessionloom.functions.json_walk import json_fields
from sessionloom.functions.sensitive import prohibited_document_name, secret_detector
from sessionloom.functions.times import parse_rfc3339
from sessionloom.functions.variants import (
    as_object,
    member,
    not_blank,
    single_json,
    string_or_null,
)
from sessionloom.schemas import SUPPORTED_TOOL
from sessionloom.session import require_settings

# Required metadata in the order in which a missing one is reported.
REQUIRED_METADATA = [
    "fixture_version",
    "fixture_origin",
    "provider",
    "tool",
    "tool_version",
    "captured_at",
    "sanitisation_reviewed",
    "payload",
]
DOCUMENT_VERSION = 1
DOCUMENT_ORIGINS = ["synthetic", "observed-sanitised"]


def _violation(path: Column | str, code: Column | str) -> Column:
    as_column = lambda value: value if isinstance(value, Column) else F.lit(value)
    return F.struct(as_column(path).alias("path"), as_column(code).alias("code"))


def _is_number(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return F.coalesce(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))


def metadata_violation(document: Column) -> Column:
    """First violated metadata rule of a document, NULL when all hold."""
    value = {name: member(document, name) for name in REQUIRED_METADATA}

    def text(name: str) -> Column:
        return string_or_null(value[name])

    version_ok = _is_number(value["fixture_version"]) & (
        value["fixture_version"].try_cast("double") == DOCUMENT_VERSION
    )
    reviewed_ok = (F.schema_of_variant(value["sanitisation_reviewed"]) == "BOOLEAN") & value[
        "sanitisation_reviewed"
    ].try_cast("boolean")
    rules = [
        ("fixture_version", "invalid_version", version_ok),
        ("fixture_origin", "invalid_origin", text("fixture_origin").isin(DOCUMENT_ORIGINS)),
        ("provider", "blank_text", not_blank(text("provider"))),
        ("tool", "blank_text", not_blank(text("tool"))),
        ("tool_version", "blank_text", not_blank(text("tool_version"))),
        ("tool", "unsupported_tool", text("tool") == SUPPORTED_TOOL),
        ("captured_at", "invalid_time", parse_rfc3339(text("captured_at")).isNotNull()),
        ("sanitisation_reviewed", "not_reviewed", reviewed_ok),
        ("payload", "not_an_object", as_object(value["payload"]).isNotNull()),
    ]
    missing = [F.when(value[name].isNull(), _violation(name, "missing")) for name in REQUIRED_METADATA]
    broken = [
        F.when(~F.coalesce(holds, F.lit(False)), _violation(path, code)) for path, code, holds in rules
    ]
    return F.coalesce(*missing, *broken)


def content_violation(fields: Column) -> Column:
    """First prohibited name or likely secret in a document's field list, NULL when clean.

    Fields come depth first over sorted keys, so a field's own name is judged before anything
    below it. The name of the rule tells which detector fired.
    """

    def rule(field: Column) -> Column:
        return F.coalesce(
            F.when(prohibited_document_name(field["name"]), "prohibited_field"),
            F.when(field["text"].isNotNull(), secret_detector(field["text"])),
        )

    judged = F.transform(fields, lambda field: _violation(field["path"], rule(field)))
    return F.get(F.filter(judged, lambda found: found["code"].isNotNull()), F.lit(0))


def audit_documents(documents: DataFrame) -> DataFrame:
    """Add ``document`` (VARIANT) and ``violation`` (path, code; NULL when clean).

    Only documents whose metadata is in order are walked. What the parser refuses is read by a
    scanner without its limits: a document that is valid all the same gets the violation it has,
    and no ``document``, since a VARIANT cannot hold it.
    """
    require_settings(documents.sparkSession)
    parsed = evaluate_once(documents, {"document": single_json(F.col("body"))})
    scanner = document_scanner(tuple(REQUIRED_METADATA))
    scanned = parsed.withColumn("_scan", scanner(F.when(F.col("document").isNull(), F.col("body"))))
    # The members of a scanned document are a small document of their own.
    judged = F.coalesce(F.col("document"), single_json(F.col("_scan.members")))
    scanned = evaluate_once(scanned, {"_judged": judged})
    broken_json = as_object(F.col("_judged")).isNull() & ~F.is_variant_null("_judged")
    metadata = F.when(
        F.col("_judged").isNull() | broken_json, _violation("", "invalid_json")
    ).otherwise(metadata_violation(F.col("_judged")))
    checked = evaluate_once(scanned, {"_metadata": metadata})
    fields = json_fields(F.when(F.col("_metadata").isNull(), F.to_json("document")))
    walked = checked.withColumn("_fields", fields)
    scan_violation = F.when(F.col("_scan.code").isNotNull(), _violation(F.col("_scan.path"), F.col("_scan.code")))
    violation = F.coalesce(F.col("_metadata"), content_violation(F.col("_fields")), scan_violation)
    return evaluate_once(walked, {"violation": violation}).drop("_metadata", "_fields", "_scan", "_judged")


def audit_report(audited: DataFrame) -> DataFrame:
    """One row per violating document: ``document_id``, ``path``, ``code``."""
    return audited.filter(F.col("violation").isNotNull()).select(
        "document_id", F.col("violation.path").alias("path"), F.col("violation.code").alias("code")
    )


def secret_hits(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of a text table in which a secret detector fires, with the detector's name."""
    judged = evaluate_once(texts.select(key, text), {"detector": secret_detector(F.col(text))})
    return judged.filter(F.col("detector").isNotNull()).select(key, "detector")
