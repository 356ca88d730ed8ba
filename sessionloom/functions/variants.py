"""Small vocabulary for reading open JSON held in VARIANT columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use the result several times in ``body``."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def single_json(text: Column) -> Column:
    """The one JSON value in ``text``, or NULL when the text is not exactly one JSON value.

    JSON parsers stop after the first value, so the text is parsed inside an array that ends
    in its own digest. Trailing text cannot forge that last element.
    """
    digest = F.sha2(text, 256)
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]')))
    return bind(
        as_array(wrapped),
        lambda items: F.when(
            (F.size(items) == 2) & (F.get(items, F.lit(1)).try_cast("string") == digest),
            F.get(items, F.lit(0)),
        ),
    )


def as_object(value: Column) -> Column:
    return value.try_cast("map<string,variant>")


def as_array(value: Column) -> Column:
    return value.try_cast("array<variant>")


def member(value: Column, name: str) -> Column:
    """Member ``name`` of an object; NULL when absent or when ``value`` is no object."""
    return F.try_variant_get(value, f"$['{name}']", "variant")


def is_string(value: Column) -> Column:
    """True only for a JSON string. Meant for places where a scalar is expected."""
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def string_or_null(value: Column) -> Column:
    """The text of a JSON string; NULL for any other type."""
    return F.when(is_string(value), value.cast("string"))


def absent(value: Column) -> Column:
    """True when the member is missing or is JSON null."""
    return value.isNull() | F.is_variant_null(value)


def not_blank(text: Column) -> Column:
    """True when the text has a character other than Unicode white space."""
    return F.coalesce(text.rlike(r"[^\s\x0B\x85\p{Z}]"), F.lit(False))
