"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from slowtrace.plans.registry import ORACLES, QUERIES, Query

_MODULES = [
    "accounting_queries", "series_queries", "latency_queries", "relation_queries", "source_queries", "streaming_queries",
]


def _load() -> None:
    for name in _MODULES:
        import_module(f"slowtrace.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
