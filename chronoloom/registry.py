"""Every query of the timeline engine by name, with its SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "win06_gaps"

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated (spark, sf_dir) function under name."""

    def put(f):
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return put


def queries() -> dict[str, Callable]:
    load()
    return _QUERIES


def oracles() -> dict[str, str]:
    load()
    return _ORACLES


def load() -> None:
    """Import the modules that register queries; not when this module is imported, since tasks import them one by one."""
    from chronoloom.plans import aggregate_queries, file_queries, join_queries, projection_queries, refine_queries, sequence_queries, sink_queries, stream_queries, text_queries, window_queries  # noqa: F401
