import random

from helpers import by, events, utc

from sessionloom.operators.sessions import (
    deduplicate,
    finish_sessions,
    fold_events,
    merge_folds,
    new_events,
    rebuild_sessions,
    rebuild_touched,
    session_timeline,
)


def rebuilt(spark, rows):
    return by(rebuild_sessions(deduplicate(events(spark, rows), ["ingest_seq"])), "session_id")


def test_out_of_order_and_duplicate_events(spark):
    done = ("done", "s", "session.completed", "2026-01-02T10:00:00")
    found = rebuilt(spark, [done, ("new", "s", "session.created", "2026-01-02T09:00:00"), done])["s"]
    assert (found.state, found.event_count) == ("completed", 2)
    assert found.started_at.isoformat() == "2026-01-02T09:00:00"
    assert found.completed_at.isoformat() == "2026-01-02T10:00:00"


def test_later_activity_reopens_a_session(spark):
    found = rebuilt(
        spark,
        [("a", "s", "session.completed", "2026-01-02T09:00:00"), ("b", "s", "session.active", "2026-01-02T10:00:00")],
    )["s"]
    assert found.state == "active" and found.completed_at is None


def test_states_ties_and_plain_events(spark):
    found = rebuilt(
        spark,
        [
            ("b", "tie", "x.failed", "2026-01-02T09:00:00"),
            ("a", "tie", "x.created", "2026-01-02T09:00:00"),
            ("c", "plain", "tool.observed", "2026-01-02T09:00:00"),
            ("d", "sub", "x.cancelled", "2026-01-02T09:00:00.500000"),
            ("e", "sub", "x.started", "2026-01-02T09:00:00"),
            ("f", "gone", "genai.model.request.abandoned", "2026-01-02T09:00:00"),
            ("g", "gone", "restarted", "2026-01-02T10:00:00"),
        ],
    )
    assert {name: row.state for name, row in found.items()} == {
        "tie": "failed",
        "plain": "unknown",
        "sub": "cancelled",
        "gone": "abandoned",
    }
    assert found["plain"].completed_at is None and found["gone"].event_count == 2


def test_duplicate_id_under_another_session_creates_none(spark):
    first = ("e", "s", "x.created", "2026-01-02T09:00:00")
    assert rebuilt(spark, [first, ("e", "other", "x.failed", "2026-01-01T09:00:00")]).keys() == {"s"}


ROWS = [
    (f"e{at}", f"s{at % 7}", kind, f"2026-01-02T{at % 5:02d}:00:00")
    for at, kind in enumerate(
        ["x.created", "x.started", "note", "x.completed", "x.failed", "x.cancelled", "other"] * 8
    )
]


def test_any_arrival_order_gives_the_same_sessions(spark):
    expected = rebuilt(spark, ROWS)
    for seed in range(2):
        shuffled = ROWS + ROWS[:20]
        random.Random(seed).shuffle(shuffled)
        assert rebuilt(spark, shuffled) == expected


def test_merged_folds_equal_one_fold(spark):
    expected = rebuilt(spark, ROWS)
    parts = [fold_events(events(spark, ROWS[at::3])) for at in range(3)]
    assert by(finish_sessions(merge_folds(*parts)), "session_id") == expected
    assert by(finish_sessions(merge_folds(merge_folds(parts[2], parts[0]), parts[1])), "session_id") == expected


def test_touched_sessions_only(spark):
    stored = events(spark, ROWS)
    touched = by(rebuild_touched(stored, events(spark, ROWS[:2])), "session_id")
    expected = rebuilt(spark, ROWS)
    assert touched == {name: expected[name] for name in ("s0", "s1")}


def test_new_events_and_timeline(spark):
    stored = events(spark, ROWS)
    late = events(spark, [ROWS[0], ("late", "s0", "x.failed", "2026-01-01T00:00:00")])
    assert [row.event_id for row in new_events(late, stored).collect()] == ["late"]
    line = [(row.occurred_at, row.event_id) for row in session_timeline(stored, "s0").collect()]
    assert line == sorted(line) and len(line) == 8


def test_hot_event_is_combined_before_the_shuffle(spark):
    plan = deduplicate(events(spark, ROWS), ["ingest_seq"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan
    assert utc("2026-01-02T00:00:00")
