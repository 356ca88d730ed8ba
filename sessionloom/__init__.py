"""Privacy-safe telemetry analytics as Spark DataFrame jobs."""

from sessionloom.session import build_session, configure

__all__ = ["build_session", "configure"]
