"""Named queries over a warehouse folder, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def collect() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries of the library's own modules."""
    from codestrata.plans import cases, files, fixture, graphs, history, pipeline, resolution, search, security_cases, structure, symbols  # noqa: F401 - they register their queries

    return dict(QUERIES), dict(SQL)
