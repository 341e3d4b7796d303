"""Row, column and value cleaning operators.

Value filters are typed predicates (they reach the Parquet scan). Fill values
are fitted with one aggregate -- a one-row result, collected like an
estimator's parameters -- and applied as literals, so the output plan is a
plain projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.functions.columns import clean_numeric, is_numeric_type, is_text_type, qcol
from tabprobe.functions.columns import missing as _missing
from tabprobe.functions.literals import matches, not_matches, parse_literal
from tabprobe.operators.quantiles import exact_quantiles
from tabprobe.functions.aggregates import agg_row


def _check_column(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise ValueError(f"column {column!r} does not exist")


def remove_rows_by_value(df: DataFrame, column: str, value: str) -> DataFrame:
    """T4: drop rows whose cell text equals ``value`` (no match -> unchanged).
    The predicate is pushed to the Parquet scan."""
    _check_column(df, column)
    return df.where(not_matches(df, column, value))


def keep_rows_by_value(df: DataFrame, column: str, value: str) -> DataFrame:
    """T5: keep only matching rows; when nothing matches the table is unchanged.

    Whether anything matches is one early-stopping probe (``limit(1)``, row
    groups skipped by the pushed predicate); the result is then a plain
    filtered scan."""
    _check_column(df, column)
    m = matches(df, column, value)
    return df.where(m) if df.where(m).limit(1).count() else df


def drop_columns(df: DataFrame, columns: Sequence[str | int]) -> DataFrame:
    """Drop the named (or 0-based positional) columns that exist."""
    names = []
    for c in columns:
        if isinstance(c, int):
            if 0 <= c < len(df.columns):
                names.append(df.columns[c])
        elif c in df.columns:
            names.append(c)
    return df.drop(*names) if names else df


def replace_values(df: DataFrame, column: str, old: str | dict, new: str | None = None) -> DataFrame:
    """Cells whose text equals ``old`` become ``new`` (or a mapping
    ``{old: new, ...}``). The column keeps its type when every new value is a
    canonical literal of it or missing; otherwise it is widened to string."""
    _check_column(df, column)
    mapping = old if isinstance(old, dict) else {old: new}
    dt = df.schema[column].dataType
    typed = all(v is None or parse_literal(dt, str(v)) is not None for v in mapping.values())
    c = qcol(column)
    base = c if typed else c.cast("string")
    expr = base
    for o, n in reversed(list(mapping.items())):
        lit = F.lit(None if n is None else parse_literal(dt, str(n))).cast(dt) if typed else F.lit(None if n is None else str(n))
        expr = F.when(F.coalesce(matches(df, column, str(o)), F.lit(False)), lit).otherwise(expr)
    return df.withColumn(column, expr)


def _targets(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return list(df.columns) if columns is None else [c for c in columns if c in df.columns]


def drop_rows_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a missing cell in any chosen column (default all)."""
    cols = _targets(df, columns)
    if not cols:
        return df
    any_missing = F.lit(False)
    for c in cols:
        any_missing = any_missing | _missing(df, c)
    return df.where(~any_missing)


def missing_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """One aggregate, one row: missing count per column (a bounded collect)."""
    if not columns:
        return {}
    row = agg_row(df, [F.count_if(_missing(df, c)).alias(f"_m{i}") for i, c in enumerate(columns)])
    return {c: int(row[f"_m{i}"]) for i, c in enumerate(columns)}


def drop_columns_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop chosen columns that contain a missing cell (schema depends on
    the data, so the null counts are computed eagerly)."""
    m = missing_counts(df, _targets(df, columns))
    return df.drop(*[c for c, n in m.items() if n > 0])


# ------------------------------------------------------------------ filling

def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Smallest of the most frequent values per column, counted in the column's
    own type (NaN is missing): a distributed value count and a bounded top-1
    per column."""
    out: dict[str, object] = {}
    by_type: dict[str, list[str]] = {}
    for c in columns:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for cols in by_type.values():  # one pass per type: values keep their type
        long = df.select(*[F.when(~_missing(df, c), qcol(c)).alias(c) for c in cols]).unpivot(
            [], [qcol(c) for c in cols], "column_name", "value").where(F.col("value").isNotNull())
        counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("c"))
        w = Window.partitionBy("column_name").orderBy(F.col("c").desc(), F.col("value").asc())
        for r in counts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").collect():  # one row per column
            out[r["column_name"]] = r["value"]
    return out


def fill_missing(df: DataFrame, method: str = "mean",
                 columns: Sequence[str] | None = None) -> DataFrame:
    """Fill missing cells of the chosen columns that have any.

    mean / median: numeric columns use the statistic (integer columns widen to
    double), other columns the mode. mode: the smallest most frequent value; an
    all-missing column gets 0 / "Unknown". zero: 0 / "". Columns that are
    neither numeric nor text keep their type: they are filled with their mode (also
    by ``zero``, which has no zero for them) and stay missing when all cells are.
    """
    if method not in ("mean", "median", "mode", "zero"):
        raise ValueError(f"unknown fill method: {method!r}")
    cols = _targets(df, columns)
    m = missing_counts(df, cols)
    todo = [c for c in cols if m.get(c, 0) > 0]
    if not todo:
        return df
    num = [c for c in todo if is_numeric_type(df.schema[c].dataType)]
    txt = [c for c in todo if is_text_type(df.schema[c].dataType)]
    rest = [c for c in todo if c not in num and c not in txt and not isinstance(df.schema[c].dataType, T.MapType)]
    fills: dict[str, object] = {}
    if method == "zero":
        fills.update({c: 0 for c in num})
        fills.update({c: "" for c in txt})
    mode_cols = rest + (txt if method != "zero" else []) + (num if method == "mode" else [])
    modes = column_modes(df, mode_cols) if mode_cols else {}
    fills.update({c: modes.get(c, "Unknown" if c in txt else 0 if c in num else None) for c in mode_cols})
    if method == "mean" and num:
        row = df.agg(*[F.avg(clean_numeric(df, c)).alias(c) for c in num]).first()
        fills.update({c: row[c] for c in num})
    elif method == "median" and num:
        q = {r["column_name"]: r["value"] for r in exact_quantiles(df, num, (0.5,)).collect()}
        fills.update({c: q.get(c) for c in num})
    exprs = {}
    for c, v in fills.items():
        dt = df.schema[c].dataType
        x = F.when(~_missing(df, c), qcol(c))
        if v is None:
            continue
        # a statistic of an integer or decimal column is a double
        tgt = T.DoubleType() if c in num and isinstance(v, float) and not isinstance(dt, (T.FloatType, T.DoubleType)) else dt
        exprs[c] = F.coalesce(x.cast(tgt), F.lit(v).cast(tgt))
    return df.withColumns(exprs) if exprs else df


def fill_mean(df, columns=None):
    return fill_missing(df, "mean", columns)


def fill_median(df, columns=None):
    return fill_missing(df, "median", columns)


def fill_mode(df, columns=None):
    return fill_missing(df, "mode", columns)


def fill_zero(df, columns=None):
    return fill_missing(df, "zero", columns)


def drop_duplicates(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Full-row distinct with missing values equal. When a position column
    is carried, the first occurrence (smallest position) is kept.

    Only an 8-byte row hash is shuffled for every row; full rows are grouped
    only where hashes collide."""
    from tabprobe.operators.profile import comparable, row_hash
    kinds, names = df.schema, df.columns
    df = comparable(df)
    keyed = row_id is not None and row_id in df.columns
    others = [c for c in df.columns if not (keyed and c == row_id)]
    # rows with a unique row hash are unique: only the colliding ones are grouped
    hashed = df.withColumn("_h", row_hash(df, others))
    repeated = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_hn")).where(F.col("_hn") > 1).select("_h")
    single = hashed.join(repeated, "_h", "left_anti")
    multi = hashed.join(repeated, "_h", "left_semi")
    if keyed:
        merged = multi.groupBy("_h", *[qcol(c) for c in others]).agg(F.min(row_id).alias(row_id))
    else:
        merged = multi.dropDuplicates(["_h", *others])
    back = [F.map_from_entries(qcol(c)).alias(c) if isinstance(kinds[c].dataType, T.MapType) else qcol(c) for c in names]
    return single.unionByName(merged).drop("_h").select(*back)
