"""Where queries and their DuckDB text are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql if sql.lstrip().startswith(("WITH", "SELECT")) else f"WITH {views.SQL.strip()}, {sql}"
        return f

    return add


def v(sql: str) -> str:
    """A select over the views; further views come first, after a comma."""
    return f"WITH {views.SQL.strip()}{sql if sql.startswith(',') else ' ' + sql}"
