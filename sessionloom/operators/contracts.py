"""Contract conformance of documents against version 0.1.0 of the four contracts.

Every contract is a fixed list of column rules over a VARIANT document. The result is an array
of violation codes ``rule:path``; an empty array means the document conforms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.evaluate import evaluate_once
from sessionloom.functions.variants import as_array, as_object, is_string, member, string_or_null
from sessionloom.schemas import (
    POLICY_OUTCOMES,
    PRIVACY_LEVELS,
    SCHEMA_VERSION,
    SESSION_STATES,
)


def _code(holds: Column, code: str) -> Column:
    return F.when(~F.coalesce(holds, F.lit(False)), F.lit(code))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


# A rule maps (value, path) to the columns that hold a violation code or NULL. It is applied
# only where the member is present.
def text(value: Column, path: str) -> list[Column]:
    return [_code(string_or_null(value) != "", f"text:{path}")]


def any_text(value: Column, path: str) -> list[Column]:
    return [_code(is_string(value), f"type:{path}")]


def text_or_null(value: Column, path: str) -> list[Column]:
    return [_code(is_string(value) | F.is_variant_null(value), f"type:{path}")]


def an_object(value: Column, path: str) -> list[Column]:
    return [_code(as_object(value).isNotNull(), f"type:{path}")]


def a_boolean(value: Column, path: str) -> list[Column]:
    return [_code(_kind(value) == "BOOLEAN", f"type:{path}")]


def false(value: Column, path: str) -> list[Column]:
    is_false = (_kind(value) == "BOOLEAN") & ~value.try_cast("boolean")
    return [_code(is_false, f"value:{path}")]


def whole_number_from(least: int):
    def rule(value: Column, path: str) -> list[Column]:
        number = value.try_cast("double")
        numeric = _kind(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        return [_code(numeric & (number == F.floor(number)) & (number >= least), f"value:{path}")]

    return rule


def one_of(*allowed: str):
    def rule(value: Column, path: str) -> list[Column]:
        return [_code(string_or_null(value).isin(list(allowed)), f"value:{path}")]

    return rule


class ClosedObject:
    """An object with exactly the named members, each under its own rule."""

    def __init__(self, members: dict) -> None:
        self.members = members


def _evidence(value: Column, path: str) -> list[Column]:
    """A list whose items are closed objects of two non-empty texts."""

    def item_ok(item: Column) -> Column:
        members = as_object(item)
        texts_ok = (string_or_null(member(item, "kind")) != "") & (
            string_or_null(member(item, "reference")) != ""
        )
        return F.coalesce((F.size(members) == 2) & texts_ok, F.lit(False))

    return [_code(F.forall(as_array(value), item_ok), f"items:{path}")]


EVENT_CONTRACT = ClosedObject(
    {
        "schema_version": one_of(SCHEMA_VERSION),
        "event_id": text,
        "event_type": text,
        "occurred_at": any_text,
        "received_at": any_text,
        "provider": text,
        "tool": text,
        "source_schema": text,
        "source_version": text,
        "actor_id": text,
        "device_id": text,
        "session_id": text,
        "task_id": text_or_null,
        "repository_id": text_or_null,
        "privacy_level": one_of(*PRIVACY_LEVELS),
        "attributes": an_object,
        "provider_extensions": an_object,
    }
)
SESSION_CONTRACT = ClosedObject(
    {
        "schema_version": one_of(SCHEMA_VERSION),
        "session_id": text,
        "provider": text,
        "tool": text,
        "state": one_of(*SESSION_STATES),
        "started_at": any_text,
        "completed_at": text_or_null,
        "attributes": an_object,
        "provider_extensions": an_object,
    }
)
POLICY_CONTRACT = ClosedObject(
    {
        "schema_version": one_of(SCHEMA_VERSION),
        "policy_id": text,
        "policy_version": text,
        "outcome": one_of(*POLICY_OUTCOMES),
        "evidence": _evidence,
    }
)
SETTINGS_CONTRACT = ClosedObject(
    {
        "schema_version": one_of(SCHEMA_VERSION),
        "mode": one_of("local-only"),
        "collection": ClosedObject(
            {
                "level": one_of("aggregate", "operational"),
                "prompts": false,
                "responses": false,
                "source_code": false,
                "file_paths": one_of("hash"),
                "command_arguments": one_of("redact"),
                "tool_calls": a_boolean,
                "model_usage": a_boolean,
            }
        ),
        "storage": ClosedObject({"destination": one_of("local"), "retention_days": whole_number_from(1)}),
        "sharing": ClosedObject(
            {
                "diagnostics": false,
                "anonymous_analytics": false,
                "research_sessions": one_of("explicit-only"),
            }
        ),
    }
)


def _path(parent: str, name: str) -> str:
    return f"{parent}.{name}" if parent else name


def _member(held: Column, name: str) -> Column:
    return F.try_element_at(held, F.lit(name))


def _with_objects(documents: DataFrame, contract: ClosedObject, document: str) -> tuple[DataFrame, dict[str, Column]]:
    """Compute the member map of every closed object once per row, level by level, as columns."""
    frame = evaluate_once(documents, {"_object": as_object(F.col(document))})
    objects, level = {"": F.col("_object")}, [("", contract)]
    while level := [
        (_path(path, name), inner, _member(objects[path], name))
        for path, outer in level
        for name, inner in outer.members.items()
        if isinstance(inner, ClosedObject)
    ]:
        names = {f"_object_{len(objects) + at}": as_object(value) for at, (_, _, value) in enumerate(level)}
        frame = evaluate_once(frame, names)
        objects |= {path: F.col(name) for (path, _, _), name in zip(level, names)}
        level = [(path, inner) for path, inner, _ in level]
    return frame, objects


def _codes(contract: ClosedObject, objects: dict[str, Column], path: str = "") -> list[Column]:
    """Columns that hold a violation code or NULL, for an object and the closed objects inside it."""
    held, found = objects[path], []
    for name, inner in contract.members.items():
        here, value = _path(path, name), _member(held, name)
        found.append(F.when(held.isNotNull() & value.isNull(), f"missing:{here}"))
        if isinstance(inner, ClosedObject):
            found.append(F.when(value.isNotNull(), _code(objects[here].isNotNull(), f"type:{here}")))
            found += _codes(inner, objects, here)
        else:
            found += [F.when(value.isNotNull(), code) for code in inner(value, here)]
    return found


def _unknown_members(contract: ClosedObject, objects: dict[str, Column], path: str = "") -> list[Column]:
    """Arrays of unknown-member codes, one for each closed object."""
    unknown = F.filter(F.map_keys(objects[path]), lambda key: ~key.isin(list(contract.members)))
    codes = F.transform(unknown, lambda key: F.concat(F.lit(f"unknown:{_path(path, '')}"), key))
    found = [F.coalesce(codes, F.array().cast("array<string>"))]
    for name, inner in contract.members.items():
        if isinstance(inner, ClosedObject):
            found += _unknown_members(inner, objects, _path(path, name))
    return found


def contract_violations(documents: DataFrame, contract: ClosedObject, document: str = "document") -> DataFrame:
    """Add ``violations``, the sorted codes of every broken rule (empty when conforming)."""
    frame, objects = _with_objects(documents, contract, document)
    whole = _code(objects[""].isNotNull(), "type:$")
    broken = F.array_compact(F.array(whole, *_codes(contract, objects)))
    violations = F.array_sort(F.concat(broken, *_unknown_members(contract, objects)))
    return frame.select(*documents.columns, violations.alias("violations"))


SETTINGS_TYPE = (
    "schema_version string, mode string, "
    "collection struct<level:string,prompts:boolean,responses:boolean,source_code:boolean,"
    "file_paths:string,command_arguments:string,tool_calls:boolean,model_usage:boolean>, "
    "storage struct<destination:string,retention_days:int>, "
    "sharing struct<diagnostics:boolean,anonymous_analytics:boolean,research_sessions:string>"
)


def first_settings_violation(settings: DataFrame) -> DataFrame:
    """Add ``violation``: the first of the thirteen ordered safety rules a settings row breaks."""
    rules = [
        ("schema_version", F.col("schema_version") == SCHEMA_VERSION),
        ("mode", F.col("mode") == "local-only"),
        ("collection.level", F.col("collection.level").isin("aggregate", "operational")),
        ("collection.prompts", ~F.col("collection.prompts")),
        ("collection.responses", ~F.col("collection.responses")),
        ("collection.source_code", ~F.col("collection.source_code")),
        ("collection.file_paths", F.col("collection.file_paths") == "hash"),
        ("collection.command_arguments", F.col("collection.command_arguments") == "redact"),
        ("storage.destination", F.col("storage.destination") == "local"),
        ("storage.retention_days", F.col("storage.retention_days") >= 1),
        ("sharing.diagnostics", ~F.col("sharing.diagnostics")),
        ("sharing.anonymous_analytics", ~F.col("sharing.anonymous_analytics")),
        ("sharing.research_sessions", F.col("sharing.research_sessions") == "explicit-only"),
    ]
    return settings.withColumn("violation", F.coalesce(*[_code(holds, path) for path, holds in rules]))
