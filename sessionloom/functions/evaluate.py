"""Control over where an expensive column is computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add computed columns whose definitions the optimizer does not copy.

    A filter on an ordinary computed column is pushed below the projection together with the
    column's whole definition, so parsing a payload would be repeated for every filter and
    branch that mentions it. Columns that come out of a generator are computed exactly once per
    row, and filters on them stay above it. The generator emits one row per input row.
    """
    rows = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    return frame.select("*", F.inline(rows).alias(*columns))
