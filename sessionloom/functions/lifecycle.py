"""Session lifecycle read from event types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionloom.schemas import TERMINAL_STATES

# The suffix of an event type and the session state it announces.
LIFECYCLE_SUFFIXES = {
    ".created": "created",
    ".active": "active",
    ".started": "active",
    ".completed": "completed",
    ".failed": "failed",
    ".cancelled": "cancelled",
    ".abandoned": "abandoned",
}


def lifecycle_state(event_type: Column) -> Column:
    """State announced by an event type, NULL for events outside the lifecycle."""
    suffix = F.regexp_extract(event_type, r"(\.[a-z]+)\z", 1)
    states = F.create_map(*[F.lit(text) for pair in LIFECYCLE_SUFFIXES.items() for text in pair])
    return F.try_element_at(states, suffix)


def is_terminal(state: Column) -> Column:
    return state.isin(TERMINAL_STATES)
