"""One-row aggregates over many expressions, in chunks.

A single aggregate with thousands of functions leaves generated code and
slows down by an order of magnitude (measured: 500 ``corr`` per aggregate took
14x longer than 50). Fitted values and checks therefore evaluate their
expressions in chunks; each chunk is one pass and one bounded row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

EXPRS_PER_AGGREGATE = 256


def agg_row(df: DataFrame, exprs: Sequence[Column]) -> dict:
    """Evaluate aggregate expressions (each with a unique alias) -> {alias: value}."""
    out: dict = {}
    for start in range(0, len(exprs), EXPRS_PER_AGGREGATE):
        out.update(df.agg(*exprs[start:start + EXPRS_PER_AGGREGATE]).first().asDict())
    return out
