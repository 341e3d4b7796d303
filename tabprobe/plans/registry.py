"""Registry of named queries: each is ``(spark, sf_dir) -> DataFrame`` with an
optional SQL twin that DuckDB runs over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its DuckDB twin, if SQL can express it."""
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def r6(expr: str) -> str:
    """Round a SQL double expression to 6 places (both sides round)."""
    return f"round(CAST({expr} AS DOUBLE), 6)"
