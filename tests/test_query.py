import pytest
from helpers import by, events, utc

from sessionloom.operators import query
from sessionloom.operators.query import Cursor, SessionFilter
from sessionloom.operators.sessions import rebuild_sessions

ROWS = [
    ("1", "oldest", "x.completed", "2026-01-02T09:00:00", "model-a"),
    ("2", "middle", "x.failed", "2026-01-02T10:00:00", "model-b"),
    ("3", "newest", "x.failed", "2026-01-02T11:00:00", "model-b"),
    ("4", "newest", "note", "2026-01-02T12:00:00", "model-b"),
    ("5", "tied", "x.abandoned", "2026-01-02T10:00:00"),
]


@pytest.fixture(scope="module")
def tables(spark):
    stored = events(spark, ROWS)
    return rebuild_sessions(stored), stored


def test_times_need_a_zone():
    naive = utc("2026-01-02T09:00:00").replace(tzinfo=None)
    for wrong in (lambda: Cursor(naive, "a"), lambda: SessionFilter(started_after=naive)):
        with pytest.raises(ValueError, match="time zone"):
            wrong()


def names(frame):
    return [row.session_id for row in frame.collect()]


def test_filters_and_order(tables):
    sessions, stored = tables
    assert names(query.list_sessions(sessions, SessionFilter())) == ["newest", "tied", "middle", "oldest"]
    wanted = SessionFilter(model="model-b", outcome="failed", started_after=utc("2026-01-02T10:30:00"))
    assert names(query.list_sessions(sessions, wanted, stored)) == ["newest"]
    assert names(query.list_sessions(sessions, SessionFilter(outcome="no-such-state"))) == []
    assert names(query.list_sessions(sessions, SessionFilter(tool="other"))) == []
    assert names(query.list_sessions(sessions, SessionFilter(model="unavailable"), stored)) == []


def test_range_is_inclusive_then_exclusive(tables):
    wanted = SessionFilter(started_after=utc("2026-01-02T10:00:00"), started_before=utc("2026-01-02T11:00:00"))
    assert sorted(names(query.filter_sessions(tables[0], wanted))) == ["middle", "tied"]


def test_pages_follow_the_cursor(tables):
    sessions, seen, cursor = tables[0], [], None
    for _ in range(5):
        page = query.session_page(sessions, SessionFilter(limit=1, cursor=cursor)).collect()
        assert len(page) == 1
        seen.append(page[0].session_id)
        if page[0].next_session_id is None:
            break
        cursor = Cursor(page[0].next_started_at.replace(tzinfo=utc("2026-01-01T00:00:00").tzinfo), page[0].next_session_id)
    assert seen == ["newest", "tied", "middle", "oldest"]
    full = query.session_page(sessions, SessionFilter(limit=4)).collect()
    assert [row.next_session_id for row in full] == [None] * 4


@pytest.mark.parametrize("limit", [0, 101, -1])
def test_limits_are_checked(limit):
    with pytest.raises(ValueError, match="limit"):
        SessionFilter(limit=limit)


def test_empty_range_is_an_error():
    at = utc("2026-01-02T10:00:00")
    with pytest.raises(ValueError, match="started_after"):
        SessionFilter(started_after=at, started_before=at)


def test_lookup_summary_and_labels(tables):
    sessions, stored = tables
    assert names(query.session_by_id(sessions, "tied")) == ["tied"]
    assert names(query.session_by_id(sessions, "none")) == []
    assert by(query.outcome_counts(sessions), "state", "sessions") == {"completed": 1, "failed": 2, "abandoned": 1}
    assert query.outcome_summary(sessions).first().asDict() == {
        "sessions": 4,
        "completed": 1,
        "failed": 2,
        "abandoned": 1,
    }
    assert [row.tool for row in query.observed_tools(sessions).collect()] == ["codex"]
    labels = by(query.labelled_sessions(sessions), "session_id")
    assert labels["newest"].model_label == "unavailable" and labels["newest"].event_count_label == "2"
    kept = query.without_sessions(stored, query.session_by_id(sessions, "newest"))
    assert sorted(set(names(kept))) == ["middle", "oldest", "tied"]


def test_top_k_does_not_sort_everything(tables):
    plan = query.list_sessions(tables[0], SessionFilter())._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
