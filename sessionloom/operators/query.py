"""Session queries: filters, keyset pages, deletion and dashboard summaries."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.schemas import UNAVAILABLE

# Page sizes of a session list.
DEFAULT_LIMIT = 50
MAXIMUM_LIMIT = 100


def _zoned(name: str, at: datetime | None) -> None:
    if at is not None and at.tzinfo is None:
        raise ValueError(f"{name} must have a time zone")


@dataclass(frozen=True)
class Cursor:
    """Last session of a page; the next page starts below it. Its time has a zone."""

    started_at: datetime
    session_id: str

    def __post_init__(self) -> None:
        _zoned("started_at", self.started_at)


@dataclass(frozen=True)
class SessionFilter:
    """Constraints of a session list; empty values do not filter.

    The model filter looks at events. A session whose model is unknown never matches it.
    """

    tool: str = ""
    model: str = ""
    outcome: str = ""
    started_after: datetime | None = None
    started_before: datetime | None = None
    cursor: Cursor | None = None
    limit: int = DEFAULT_LIMIT

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= MAXIMUM_LIMIT:
            raise ValueError(f"limit must be an integer from 1 to {MAXIMUM_LIMIT}")
        _zoned("started_after", self.started_after)
        _zoned("started_before", self.started_before)
        both = self.started_after is not None and self.started_before is not None
        if both and not self.started_after < self.started_before:
            raise ValueError("started_after must be before started_before")


def session_by_id(sessions: DataFrame, session_id: str) -> DataFrame:
    """The session with this id; empty when there is none."""
    return sessions.filter(F.col("session_id") == session_id)


def _below(cursor: Cursor) -> Column:
    started, at = F.col("started_at"), F.lit(cursor.started_at)
    return (started < at) | ((started == at) & (F.col("session_id") < cursor.session_id))


def filter_sessions(sessions: DataFrame, wanted: SessionFilter, events: DataFrame | None = None) -> DataFrame:
    """Sessions that meet every supplied constraint, in no particular order."""
    if wanted.tool:
        sessions = sessions.filter(F.col("tool") == wanted.tool)
    if wanted.outcome:
        sessions = sessions.filter(F.col("state") == wanted.outcome)
    if wanted.started_after is not None:
        sessions = sessions.filter(F.col("started_at") >= F.lit(wanted.started_after))
    if wanted.started_before is not None:
        sessions = sessions.filter(F.col("started_at") < F.lit(wanted.started_before))
    if wanted.cursor is not None:
        sessions = sessions.filter(_below(wanted.cursor))
    if wanted.model:
        if events is None:
            raise ValueError("the model filter needs the event table")
        # One row per session before the join, so a hot session cannot dominate a join task.
        matching = events.filter(F.col("model") == wanted.model).select("session_id").distinct()
        sessions = sessions.join(matching, "session_id", "left_semi")
    return sessions


def newest_first(sessions: DataFrame, count: int) -> DataFrame:
    """The newest ``count`` sessions in page order."""
    return sessions.orderBy(F.desc("started_at"), F.desc("session_id")).limit(count)


def list_sessions(sessions: DataFrame, wanted: SessionFilter, events: DataFrame | None = None) -> DataFrame:
    """One page plus a look-ahead row, newest first."""
    return newest_first(filter_sessions(sessions, wanted, events), wanted.limit + 1)


def session_page(sessions: DataFrame, wanted: SessionFilter, events: DataFrame | None = None) -> DataFrame:
    """One page without the look-ahead row.

    ``page_rank`` counts from 1. ``next_started_at`` and ``next_session_id`` are set on the
    last row of a page that has a successor and NULL everywhere else. The single-partition
    window sees at most ``limit + 1`` (101) rows.
    """
    page_order = Window.orderBy(F.desc("started_at"), F.desc("session_id"))
    ranked = list_sessions(sessions, wanted, events).withColumns(
        {
            "page_rank": F.row_number().over(page_order),
            "_has_next": F.lead(F.lit(True)).over(page_order),
        }
    )
    turns = F.col("_has_next") & (F.col("page_rank") == wanted.limit)
    return (
        ranked.withColumns(
            {
                "next_started_at": F.when(turns, F.col("started_at")),
                "next_session_id": F.when(turns, F.col("session_id")),
            }
        )
        .filter(F.col("page_rank") <= wanted.limit)
        .drop("_has_next")
    )


def without_sessions(table: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of any table with a ``session_id`` that survive the deletion of sessions.

    The deleted ids are distinct, so only the table side can be skewed; adaptive execution
    splits that side of an anti join when one session makes a partition too large.
    """
    return table.join(deleted.select("session_id").distinct(), "session_id", "left_anti")


def outcome_counts(sessions: DataFrame) -> DataFrame:
    """Number of sessions per state."""
    return sessions.groupBy("state").agg(F.count(F.lit(1)).alias("sessions"))


def outcome_summary(sessions: DataFrame) -> DataFrame:
    """The overview numbers: all, completed, failed and abandoned sessions."""
    return sessions.agg(
        F.count(F.lit(1)).alias("sessions"),
        *[F.count_if(F.col("state") == state).alias(state) for state in ("completed", "failed", "abandoned")],
    )


def observed_tools(sessions: DataFrame) -> DataFrame:
    """Distinct tools that have supplied sessions."""
    return sessions.select("tool").distinct()


def labelled_sessions(sessions: DataFrame) -> DataFrame:
    """Presentation view in which unknown values read ``unavailable`` instead of zero or blank.

    A session carries no model of its own, so that label is always ``unavailable``.
    """
    def label(text: Column) -> Column:
        return F.coalesce(text, F.lit(UNAVAILABLE))

    completed = F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss")
    return sessions.select(
        "session_id",
        F.col("state").alias("outcome"),
        label(completed).alias("completed_label"),
        F.lit(UNAVAILABLE).alias("model_label"),
        label(F.col("event_count").cast("string")).alias("event_count_label"),
    )
