"""All registered queries: a Spark function and, where possible, the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None):
    """Decorator: file a query under ``name`` with its SQL twin, if it has one."""
    def keep(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = (function, sql)
        return function
    return keep


def _load() -> None:
    from . import q_events, q_functions, q_inventory, q_jobs, q_pairs, q_segments, q_streams  # noqa: F401


def all_queries() -> dict[str, Query]:
    _load()
    return {name: query for name, (query, _) in _QUERIES.items()}


def all_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
