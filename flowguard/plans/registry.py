"""The table of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowguard.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, views: str = ""):
    """Register a query; ``oracle`` is its SQL over the same tables, if it has one."""
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = with_views(views, oracle) if views else oracle.strip()
        return fn
    return add


def values_sql(rows, columns: str) -> str:
    """A constant table for the checking SQL."""
    def lit(v):
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS t({columns})"
