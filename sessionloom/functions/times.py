"""Time parsing with the strictness of the wire formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RFC3339 = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})\z"
_SIGNED_DIGITS = r"\A[+-]?[0-9]+\z"


def parse_rfc3339(text: Column) -> Column:
    """Instant of an RFC 3339 text with a zone; NULL when the text has another form."""
    normal = F.regexp_replace(text, r"[.,](\d{1,6})\d*", r".$1")
    return F.when(text.rlike(_RFC3339), F.try_to_timestamp(normal))


def parse_unix_nanos(text: Column) -> Column:
    """Positive signed 64-bit nanoseconds since the epoch; NULL for anything else."""
    nanos = F.when(text.rlike(_SIGNED_DIGITS), text.try_cast("bigint"))
    return F.when(nanos > 0, nanos)


def nanos_to_timestamp(nanos: Column) -> Column:
    """Spark instants hold microseconds; keep the nanoseconds next to them for ordering."""
    return F.timestamp_micros(F.call_function("div", nanos, F.lit(1000)))


def timestamp_to_nanos(instant: Column) -> Column:
    return F.unix_micros(instant) * F.lit(1000)
