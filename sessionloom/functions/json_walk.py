"""The recursive helpers: built-in functions cannot walk JSON of unbounded depth.

They run as Arrow-batched functions on one JSON text per row. Nested higher-order expressions
up to a fixed depth were measured as the alternative: two to eight times slower per row,
seconds of planning per query, and inexact below the depth they were built for.
"""

from __future__ import annotations

import hmac
import json
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions.hashing import check_salt
from sessionloom.functions.sensitive import (
    FOLDED_LETTERS,
    HASHED_NAMES,
    PROHIBITED_CONTENT_WORDS,
    REDACTED_NAMES,
    REMOVED_NAMES,
    REMOVED_SUFFIXES,
)
from sessionloom.schemas import PROVENANCE_TYPE

# Ship these helpers with the job, so that executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REDACTED = "[REDACTED]"
SANITISED_TYPE = (
    T.StructType().add("value", T.StringType()).add("provenance", PROVENANCE_TYPE)
)
FIELDS_TYPE = T.ArrayType(
    T.StructType()
    .add("path", T.StringType())
    .add("name", T.StringType())
    .add("text", T.StringType())
)

# What can be decided about a field, and why; entries are kept by their number until a batch ends.
REASONS = {"retained": "operational_metadata", "hashed": "file_path", "redacted": "command_arguments"}
DECISIONS = [*REASONS.items(), ("removed", "prohibited_content"), ("removed", "sensitive_value")]
RETAINED, HASHED, REMOVED = 0, 1, (3, 4)
NESTED = (dict, list)

_FOLD = str.maketrans(FOLDED_LETTERS)
_SEPARATORS = str.maketrans("", "", "_- .")


def _allow_deep_nesting() -> None:
    # The JVM parser admits 1000 nested containers; the walk must not stop before that.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10000))


def _child_path(path: str, key: str) -> str:
    return f"{path}.{key}" if path else key


def fold_name(name: str) -> str:
    """A field name in lower case, letter by letter, so that no letter becomes two."""
    return name.translate(_FOLD).lower()


def key_action(name: str) -> str:
    """What the privacy boundary does with a field of this name."""
    plain = fold_name(name).translate(_SEPARATORS)
    if plain in REDACTED_NAMES:
        return "redacted"
    if plain in HASHED_NAMES:
        return "hashed"
    if plain in REMOVED_NAMES or plain.endswith(tuple(REMOVED_SUFFIXES)):
        return "removed"
    return "retained"


def removal_reason(name: str) -> str:
    content = any(word in fold_name(name) for word in PROHIBITED_CONTENT_WORDS)
    return "prohibited_content" if content else "sensitive_value"


# One encoder for all rows; json.dumps would build a new one for each.
_ENCODER = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def _dump(value: object) -> str:
    return _ENCODER.encode(value)


def _hash_text(value: object) -> str:
    """A string is hashed as it is, null as a fixed mark, anything else as its JSON."""
    if isinstance(value, str):
        return value
    return "<nil>" if value is None else _dump(value)


def _list_of_structs(rows: list[list[tuple]], names: list[str]) -> pa.Array:
    offsets = [0]
    for row in rows:
        offsets.append(offsets[-1] + len(row))
    flat = [entry for row in rows for entry in row]
    columns = [pa.array([entry[at] for entry in flat], pa.string()) for at in range(len(names))]
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, names)
    )


def sanitiser(salt: bytes) -> Callable[[Column, Column], Column]:
    """Function of (JSON text, path prefix) giving the safe JSON and its provenance.

    Provenance is listed depth first over sorted keys, each entry by its step from the entry of the
    object around it, so that deep objects do not repeat their whole path in every entry. The salt
    travels only inside the serialised function, never in the query plan.
    """
    check_salt(salt)

    decisions: dict[str, int] = {}

    def decision_of(name: str) -> int:
        # Field names repeat from row to row; the cache is bounded against open-ended names.
        known = decisions.get(name)
        if known is None:
            if len(decisions) >= 4096:
                decisions.clear()
            action = key_action(name)
            reason = removal_reason(name) if action == "removed" else REASONS[action]
            known = decisions[name] = DECISIONS.index((action, reason))
        return known

    def keyed_hash(value: object) -> str:
        return "hmac-sha256:" + hmac.digest(salt, _hash_text(value).encode("utf-8", "surrogatepass"), "sha256").hex()

    def clean(value: dict | list, around: int, lead: str | None, rows: list[tuple]) -> dict | list:
        """``around`` is the entry of the object that holds the value, ``lead`` the path from there on.

        ``lead`` is None below an entry with an empty path. Scalars need no call.
        """
        if type(value) is list:
            return [
                clean(item, around, f"{lead or ''}[{at}]", rows) if type(item) in NESTED else item
                for at, item in enumerate(value)
            ]
        safe = {}
        for key in sorted(value):
            item = value[key]
            step = key if lead is None else f"{lead}.{key}"
            up = 0 if around < 0 else len(rows) - around
            # In an attribute pair the name under "key" decides about "value".
            pair = value.get("key") if key == "value" else None
            named = type(pair) is str and pair != ""
            decision = decision_of(pair if named else key)
            if decision == RETAINED:
                # A step without text only ever begins at the top, so its path is empty too.
                inside = len(rows) if step else -1
                rows.append((up, step, decision))
                safe[key] = clean(item, inside, "" if step else None, rows) if type(item) in NESTED else item
            elif decision in REMOVED:
                rows.append((up, f"{step}.attribute_value" if named else step, decision))
                if named:
                    safe[key] = {}
            else:
                text = keyed_hash(item) if decision == HASHED else REDACTED
                rows.append((up, step, decision))
                safe[key] = {"stringValue": text} if named else text
        return safe

    @F.arrow_udf(SANITISED_TYPE)
    def sanitise(texts: pa.Array, prefixes: pa.Array) -> pa.Array:
        _allow_deep_nesting()
        # The entries of a whole batch in one list; ``ends`` says where those of a row stop.
        values, rows, ends = [], [], [0]
        for text, prefix in zip(texts.to_pylist(), prefixes.to_pylist()):
            if text is None:
                values.append(None)
            else:
                value = json.loads(text)
                values.append(_dump(clean(value, -1, prefix or None, rows) if type(value) in NESTED else value))
            ends.append(len(rows))
        ups, steps, decided = zip(*rows) if rows else ((), (), ())
        decided = pa.array(decided, pa.int32())
        entries = [
            pa.array(ups, pa.int32()),
            pa.array(steps, pa.string()),
            *[pa.array(names, pa.string()).take(decided) for names in zip(*DECISIONS)],
        ]
        provenance = pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.StructArray.from_arrays(entries, ["up", "step", "action", "reason"])
        )
        return pa.StructArray.from_arrays([pa.array(values, pa.string()), provenance], ["value", "provenance"])

    return sanitise


@F.arrow_udf(T.ArrayType(T.StringType()))
def provenance_paths(ups: pa.Array, steps: pa.Array) -> pa.Array:
    """Whole paths of provenance entries, put together level by level over a batch of lists."""
    offsets = pa.concat_arrays([pa.array([0]), pc.cumulative_sum(pc.fill_null(pc.list_value_length(ups), 0)).cast("int64")])
    up = ups.flatten().to_numpy()
    paths = steps.flatten().to_numpy(zero_copy_only=False)
    around = np.arange(len(up)) - up
    done = up == 0
    while not done.all():
        ready = np.flatnonzero(~done)
        ready = ready[done[around[ready]]]
        paths[ready] = paths[around[ready]] + paths[ready]
        done[ready] = True
    return pa.ListArray.from_arrays(offsets.cast("int32"), pa.array(paths, pa.string()))


def _fields(value: object, path: str, name: str | None, rows: list[tuple]) -> None:
    rows.append((path, name, value if isinstance(value, str) else None))
    if isinstance(value, dict):
        for key in sorted(value):
            _fields(value[key], _child_path(path, key), key, rows)
    elif isinstance(value, list):
        for at, item in enumerate(value):
            _fields(item, f"{path}[{at}]", None, rows)


@F.arrow_udf(FIELDS_TYPE)
def json_fields(texts: pa.Array) -> pa.Array:
    """Every node of a JSON text, depth first over sorted keys: path, key, string value."""
    _allow_deep_nesting()
    listed = []
    for text in texts.to_pylist():
        rows: list[tuple] = []
        if text is not None:
            _fields(json.loads(text), "", None, rows)
        listed.append(rows)
    return _list_of_structs(listed, ["path", "name", "text"])
