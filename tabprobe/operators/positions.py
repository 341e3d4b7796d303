"""Positional operators: index specs (T1-T3), paging (P12), cell edits.

Positions are an explicit ``row_id`` column (T0, see ``ordering.with_row_id``).
An index spec such as ``"1,3-5,7"`` is parsed on the driver into merged
intervals -- never expanded into a list of indices -- and applied as one
range predicate. Renumbering after a removal is arithmetic over the intervals
(positions removed before x), so it needs no second sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.operators.ordering import Directory, with_row_id


def parse_index_spec(spec: str | None) -> list[tuple[int, int]]:
    """``"1,3-5,7"`` -> merged inclusive intervals ``[(1, 1), (3, 5), (7, 7)]``.

    Blank -> ``[]``. A malformed part raises ``ValueError``. Negative positions
    are dropped (they never exist).
    """
    if spec is None or not spec.strip():
        return []
    raw = []
    for part in (p.strip() for p in spec.split(",")):
        if "-" in part:
            a, b = part.split("-")
            lo, hi = int(a), int(b)
        else:
            lo = hi = int(part)
        lo = max(lo, 0)
        if hi >= lo:
            raw.append((lo, hi))
    raw.sort()
    merged: list[tuple[int, int]] = []
    for lo, hi in raw:
        if merged and lo <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(merged[-1][1], hi))
        else:
            merged.append((lo, hi))
    return merged


def _in_intervals(x: Column, intervals: Sequence[tuple[int, int]]) -> Column:
    cond = F.lit(False)
    for lo, hi in intervals:
        cond = cond | x.between(lo, hi)
    return cond


def _count_before(x: Column, intervals: Sequence[tuple[int, int]]) -> Column:
    """Number of interval positions strictly smaller than ``x``."""
    total = F.lit(0).cast("long")
    for lo, hi in intervals:
        total = total + F.greatest(F.least(x, F.lit(hi + 1)) - F.lit(lo), F.lit(0))
    return total


def _ensure_row_id(df: DataFrame, row_id: str, order_by: Sequence[str] | None) -> DataFrame:
    return df if row_id in df.columns else with_row_id(df, order_by, name=row_id)


def remove_rows_by_index(df: DataFrame, spec: str, row_id: str = "row_id",
                         order_by: Sequence[str] | None = None) -> DataFrame:
    """Drop the rows at the listed positions and renumber the rest."""
    iv = parse_index_spec(spec)
    df = _ensure_row_id(df, row_id, order_by)
    if not iv:
        return df
    x = F.col(row_id)
    return (df.where(~_in_intervals(x, iv))
              .withColumn(row_id, x - _count_before(x, iv)))


def keep_rows_by_index(df: DataFrame, spec: str, row_id: str = "row_id",
                       order_by: Sequence[str] | None = None,
                       renumber: bool = True) -> DataFrame:
    """Keep only the listed positions (in table order) and renumber them.

    No valid position at all -> the table is returned unchanged. Positions
    are 0..n-1, so that is decided by the row count alone: the first interval
    starts at or after n. With ``order_by`` only the range buckets that hold a
    listed position are numbered; other rows are not moved.
    """
    iv = parse_index_spec(spec)
    if not iv:
        return _ensure_row_id(df, row_id, order_by)
    if row_id not in df.columns and order_by:
        where = Directory(df, order_by)
        if iv[0][0] >= where.rows:
            return _ensure_row_id(df, row_id, order_by)
        df = where.number(iv, row_id)
    elif iv[0][0] >= df.count():
        return _ensure_row_id(df, row_id, order_by)
    df = _ensure_row_id(df, row_id, order_by)
    x = F.col(row_id)
    out = df.where(_in_intervals(x, iv))
    if renumber:
        out = out.withColumn(row_id, _count_before(x, iv))
    return out


def preview_rows_by_index(df: DataFrame, spec: str, row_id: str = "row_id",
                          order_by: Sequence[str] | None = None) -> DataFrame:
    """T2 as a view that keeps the original positions."""
    return keep_rows_by_index(df, spec, row_id, order_by, renumber=False)


def page_count(n_rows: int, page_size: int) -> int:
    return max(1, -(-n_rows // page_size))


def page_rows(df: DataFrame, page: int, page_size: int, row_id: str = "row_id",
              order_by: Sequence[str] | None = None) -> DataFrame:
    """Rows of page ``page`` (1-based, clamped to the valid range).

    Clamping needs the row count: one count of the input, the figure the
    reference shows beside the page anyway. With ``order_by`` only the range
    buckets that hold the page's rows are numbered; other rows are not moved.
    """
    if page_size < 1:
        raise ValueError("page_size must be positive")
    where = Directory(df, order_by) if row_id not in df.columns and order_by else None
    rows = where.rows if where else df.count()
    lo = (min(max(page, 1), page_count(rows, page_size)) - 1) * page_size
    df = where.number([(lo, lo + page_size - 1)], row_id) if where else _ensure_row_id(df, row_id, order_by)
    return df.where(F.col(row_id).between(lo, lo + page_size - 1))


def apply_edits(df: DataFrame, edits: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Replace whole rows at the positions present in ``edits``.

    ``edits`` holds ``row_id`` plus any subset of the columns; a listed column
    takes the edited value (also a null), others keep theirs.
    """
    cols = [c for c in edits.columns if c != row_id and c in df.columns]
    e = edits.select(F.col(row_id).alias("_eid"), F.lit(True).alias("_hit"),
                     *[F.col(c).alias(f"_e_{c}") for c in cols])
    j = df.join(e, F.col(row_id) == F.col("_eid"), "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = [F.when(hit, F.col(f"_e_{c}").cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)
           if c in cols else F.col(c) for c in df.columns]
    return j.select(*out)
