"""Scaling (T15, T16) and categorical encoding.

Scalers are fitted -- like an estimator -- with one aggregate over the rows
that are complete in every chosen column, and applied only to those rows;
other rows keep their raw values. A constant column scales to 0 (the plain
aggregates are used, not ``ml.feature`` scalers, whose conventions differ).

Encoders change the schema, so the category dictionary is computed first: a
bounded, sorted collect for one-hot (hard cap), and for binary encoding only
the dictionary *size*; the dictionary itself stays distributed and is joined
back (broadcast when AQE sees it is small).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.functions.columns import clean_numeric, numeric_columns, qcol
from tabprobe.operators.ordering import with_row_id
from tabprobe.session import cut_lineage
from tabprobe.functions.aggregates import agg_row

ONEHOT_MAX_CATEGORIES = 1000
MISSING_CATEGORY = "nan"


def _complete(df: DataFrame, cols: Sequence[str]):
    cond = F.lit(True)
    for c in cols:
        cond = cond & clean_numeric(df, c).isNotNull()
    return cond


def _scale(df: DataFrame, columns: Sequence[str], method: str) -> DataFrame:
    cols = numeric_columns(df, columns)
    if not cols:
        return df
    ok = _complete(df, cols)
    fit = []
    for i, c in enumerate(cols):
        x = F.when(ok, clean_numeric(df, c))
        if method == "minmax":
            fit += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
        else:
            fit += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"b{i}"),
                    (F.min(x) == F.max(x)).alias(f"k{i}")]
    p = agg_row(df, fit)  # fitted parameters: one row
    if p["a0"] is None:  # no complete row
        return df
    exprs = {}
    for i, c in enumerate(cols):
        x = clean_numeric(df, c)
        a, b = p[f"a{i}"], p[f"b{i}"]
        if method == "minmax":
            span = b - a
            scaled = (x - F.lit(a)) / F.lit(span) if span != 0 else F.lit(0.0)
        else:
            scaled = (x - F.lit(a)) / F.lit(b) if (b and not p[f"k{i}"]) else F.lit(0.0)
        exprs[c] = F.when(ok, scaled).otherwise(x).cast("double")
    return df.withColumns(exprs)


def scale_minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min) on rows complete in all chosen columns."""
    return _scale(df, columns, "minmax")


def scale_standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population std on rows complete in all chosen columns."""
    return _scale(df, columns, "standard")


def category_text(df: DataFrame, column: str):
    """Text form of a cell for encoding; missing becomes the category ``nan``."""
    x = qcol(column)
    dt = df.schema[column].dataType
    t = x.cast("string")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        t = F.when(F.isnan(x), None).otherwise(t)
    return F.coalesce(t, F.lit(MISSING_CATEGORY))


def encode_onehot(df: DataFrame, columns: Sequence[str],
                  max_categories: int = ONEHOT_MAX_CATEGORIES) -> DataFrame:
    """One boolean column ``<col>_<value>`` per category (sorted), appended
    after the remaining columns; the encoded columns are removed. Names that
    differ in case only, or equal a kept column's, get ``_2``, ``_3``, ..."""
    cols = [c for c in columns if c in df.columns]
    if not cols:
        return df
    long = df.select(*[category_text(df, c).alias(c) for c in cols]).unpivot(
        [], [qcol(c) for c in cols], "column_name", "value")
    w = Window.partitionBy("column_name").orderBy("value")
    # one more than the cap per column is enough to refuse it
    cats = (long.distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_categories + 1)
                .orderBy("column_name", "value").collect())
    per: dict[str, list[str]] = {c: [] for c in cols}
    for r in cats:
        per[r["column_name"]].append(r["value"])
    for c in cols:
        if len(per[c]) > max_categories:
            raise ValueError(f"{c!r} has more than {max_categories} categories")
    kept = [c for c in df.columns if c not in cols]
    taken = {c.lower() for c in kept}
    dummies = []
    for c in cols:
        for v in per[c]:
            name, k = f"{c}_{v}", 1
            while name.lower() in taken:  # Spark's names ignore case: a second one gets a number
                k += 1
                name = f"{c}_{v}_{k}"
            taken.add(name.lower())
            dummies.append((category_text(df, c) == F.lit(v)).alias(name))
    return df.select(*[qcol(c) for c in kept], *dummies)


def binary_width(n_categories: int) -> int:
    """Bits used for ordinals 1..n."""
    return max(1, int(n_categories).bit_length())


def encode_binary(df: DataFrame, columns: Sequence[str],
                  order_by: Sequence[str] | None = None) -> DataFrame:
    """Ordinal 1..n by first appearance (``order_by`` order, table order
    when absent), written as bits ``<col>_0`` (most significant) ..
    ``<col>_{k-1}``; the originals are replaced by the bits at the end."""
    cols = [c for c in columns if c in df.columns]
    if not cols:
        return df
    if order_by:
        pos, keyed = F.struct(*[qcol(c) for c in order_by]), df
    else:  # fixed first: positions must agree between the dictionary and a retry
        keyed = cut_lineage(df)
        pos = F.monotonically_increasing_id()
    out = keyed
    bit_cols = []
    for c in cols:
        # first appearances by one aggregate; only the dictionary is ordered
        first = cut_lineage(keyed.select(category_text(df, c).alias("_v"), pos.alias("_pos"))
                                 .groupBy("_v").agg(F.min("_pos").alias("_first")))
        n = first.count()  # dictionary size decides the schema
        k = binary_width(n)
        if order_by:
            first = first.select("_v", "_first.*")
            by = first.columns[1:]
        else:
            by = ["_first"]
        ranked = with_row_id(first, by, name="_ord").select(
            F.col("_v").alias(f"_v_{c}"), (F.col("_ord") + 1).alias(f"_o_{c}"))
        out = out.join(ranked, category_text(df, c) == F.col(f"_v_{c}"), "left")
        for b in range(k):
            name = f"{c}_{b}"
            out = out.withColumn(name, F.shiftright(F.col(f"_o_{c}"), k - 1 - b).bitwiseAND(1).cast("int"))
            bit_cols.append(name)
        out = out.drop(f"_v_{c}", f"_o_{c}")
    keep = [c for c in df.columns if c not in cols]
    return out.select(*[qcol(c) for c in keep], *[F.col(b) for b in bit_cols])
