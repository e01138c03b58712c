"""Typed errors of the facades; the DataFrame forms stay lazy and raise none of them."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all typed errors."""


class UnknownReadView(EngineError):
    """A revision later than the current one was asked for."""


class HistoryUnavailable(EngineError):
    """A revision before the retained history was asked for."""


class ResultLimit(EngineError):
    """More rows than the caller's limit; ``actual`` is at least one more than ``limit``."""

    def __init__(self, actual: int, limit: int) -> None:
        super().__init__(f"at least {actual} rows, limit {limit}")
        self.actual, self.limit = actual, limit


class ResourceLimit(EngineError):
    """A budget of work or bytes is used up."""


class StaleView(EngineError):
    """Policy or data moved on after a view was taken."""


class Conflict(EngineError):
    """A retry under the same key that differs from the first request."""


class RetentionGap(EngineError):
    """A cursor points before the first retained revision."""
