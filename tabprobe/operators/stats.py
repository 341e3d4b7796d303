"""Descriptive statistics (S1, S2) and outlier detection.

Every operator returns a long table -- one row per column (or per column and
value) -- built from multi-column aggregates (one per chunk of columns)
instead of a loop of per-column jobs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.functions.columns import clean_numeric, numeric_columns, qcol, text_columns
from tabprobe.operators.quantiles import ColumnProfile, exact_quantiles, quantile_columns

QUARTILES = (0.25, 0.5, 0.75)


COLUMNS_PER_AGGREGATE = 64  # an oversized aggregate leaves generated code


def _per_column(df: DataFrame, columns: Sequence[str], make) -> DataFrame:
    """Aggregates over ``df`` producing one struct per column, exploded to rows
    (one aggregate per chunk of ``COLUMNS_PER_AGGREGATE`` columns)."""
    parts = []
    for start in range(0, len(columns), COLUMNS_PER_AGGREGATE):
        structs = [F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("_ord"), *make(c))
                   for i, c in enumerate(columns) if start <= i < start + COLUMNS_PER_AGGREGATE]
        parts.append(df.agg(F.array(*structs).alias("_s")).select(F.inline("_s")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _empty(df: DataFrame, ddl: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], ddl)


NUMERIC_SUMMARY_DDL = ("column_name string, n long, mean double, std double, min double, "
                       "p25 double, p50 double, p75 double, max double, "
                       "skewness double, kurtosis double")


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None,
                    approx: bool = False) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max, corrected skewness and
    excess kurtosis per numeric column.

    Two passes of plain aggregates: the first gives count, sum, min, max and
    the intervals of the quartiles; the second sums powers of the deviation
    from that mean (exact two-pass central moments) and counts the intervals.
    Quartiles are exact unless ``approx``.
    """
    cols = numeric_columns(df, columns)
    if not cols:
        return _empty(df, NUMERIC_SUMMARY_DDL)
    prof = ColumnProfile(df, cols, moments=True, probs=() if approx else QUARTILES)
    rows = []
    for i, c in enumerate(cols):
        n = prof.n[i]
        cm = prof.central_moments(i)
        mean = std = skew = kurt = None
        if cm is not None:
            _, m2, m3, m4 = cm
            mean = prof.mean[i]  # sum / n, as avg() reports it
            # a spread too small for its powers to be told from 0 counts as constant
            const = prof.min[i] == prof.max[i] or m2 <= 0 or m2 ** 1.5 == 0 or m2 * m2 == 0
            if n >= 2:
                std = math.sqrt(max(m2, 0.0) / (n - 1))
            if n >= 3:
                skew = 0.0 if const else (math.sqrt(n) * m3 / m2 ** 1.5) * math.sqrt(n * (n - 1)) / (n - 2)
            if n >= 4:
                kurt = 0.0 if const else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (n * m4 / (m2 * m2) - 3) + 6)
        rows.append((c, i, n, mean, std, None if n == 0 else float(prof.min[i]),
                     None if n == 0 else float(prof.max[i]), skew, kurt))
    ddl = ("column_name string, _ord int, n long, mean double, std double, "
           "min double, max double, skewness double, kurtosis double")
    if approx:
        mom = df.sparkSession.createDataFrame(rows, ddl)
        grid = F.array(*[F.lit(p) for p in QUARTILES])
        q = prof.wide.agg(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                             F.percentile_approx(F.col(f"_q{i}"), grid, 100000).alias("qs"))
                                    for i, c in enumerate(cols)]).alias("_s")).select(F.inline("_s")).select(
            "column_name", *[F.col("qs")[k].alias(n) for k, n in enumerate(("p25", "p50", "p75"))])
        return mom.join(F.broadcast(q), "column_name", "left").orderBy("_ord").select(
            "column_name", "n", "mean", "std", "min", "p25", "p50", "p75", "max", "skewness", "kurtosis")
    # the quartiles are columns x 3 values: collected and placed beside the moments
    qv = {(r["column_name"], r["prob"]): r["value"] for r in prof.quantiles().collect()}
    out = [(c, n, mean, std, mn, qv.get((c, 0.25)), qv.get((c, 0.5)), qv.get((c, 0.75)), mx, skew, kurt)
           for c, _, n, mean, std, mn, mx, skew, kurt in rows]
    return df.sparkSession.createDataFrame(out, NUMERIC_SUMMARY_DDL)


def text_value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, n) over the non-null cells of text columns."""
    long = df.select(*[qcol(c).cast("string").alias(c) for c in columns]).unpivot(
        [], [qcol(c) for c in columns], "column_name", "value")
    return (long.where(F.col("value").isNotNull())
                .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))


def top_values(counts: DataFrame, k: int, by: str = "column_name") -> DataFrame:
    """Top ``k`` values per group by count desc, value asc.

    The ``row_number() <= k`` filter lets Spark insert a partial group limit
    before the shuffle, so no group ships more than k rows per task.
    """
    w = Window.partitionBy(by).orderBy(F.col("n").desc(), F.col("value").asc())
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


CATEGORICAL_SUMMARY_DDL = ("column_name string, n_distinct long, mode string, mode_count long, "
                           "n_missing long, rank int, value string, value_count long")


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None,
                        top: int = 5) -> DataFrame:
    """Per text column -- distinct count, mode (smallest of the tied most
    frequent values), its count, missing count, and the ``top`` most frequent
    values (one row each)."""
    cols = text_columns(df, columns)
    if not cols:
        return _empty(df, CATEGORICAL_SUMMARY_DDL)
    counts = text_value_counts(df, cols)
    tops = top_values(counts, top)
    distinct = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    missing = _per_column(df, cols, lambda c: [F.count_if(qcol(c).isNull()).alias("n_missing")])
    modes = tops.where(F.col("rank") == 1).select(
        "column_name", F.col("value").alias("mode"), F.col("n").alias("mode_count"))
    base = (missing.join(F.broadcast(distinct), "column_name", "left")
                   .join(F.broadcast(modes), "column_name", "left")
                   .withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0))))
    out = base.join(tops.select("column_name", "rank", "value", F.col("n").alias("value_count")),
                    "column_name", "left")
    return out.orderBy("_ord", "rank").select(
        "column_name", "n_distinct", "mode", "mode_count", "n_missing",
        "rank", "value", "value_count")


# --------------------------------------------------------------------------- outliers

def outlier_bounds(df: DataFrame, method: str = "iqr",
                   columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, lower, upper, n_valid) fitted per numeric column.

    iqr: [Q1 - 1.5 IQR, Q3 + 1.5 IQR] with exact quartiles.
    zscore: |x - mean| / population std > 3, expressed as bounds; a constant
    column has no bounds (no outliers).
    """
    cols = numeric_columns(df, columns)
    if method == "iqr":
        q = quantile_columns(exact_quantiles(df, cols, (0.25, 0.75)), (0.25, 0.75), ("q1", "q3"))
        valid = _per_column(df, cols, lambda c: [F.count(clean_numeric(df, c)).alias("n_valid")])
        iqr = F.col("q3") - F.col("q1")
        return (valid.join(F.broadcast(q), "column_name", "left")
                     .select("column_name", "_ord", "n_valid",
                             (F.col("q1") - 1.5 * iqr).alias("lower"),
                             (F.col("q3") + 1.5 * iqr).alias("upper"),
                             F.lit(False).alias("_open")))
    if method == "zscore":
        def fit(c):
            x = clean_numeric(df, c)
            const = F.min(x) == F.max(x)
            sd = F.stddev_pop(x)
            return [F.count(x).alias("n_valid"),
                    F.when(const, None).otherwise(F.avg(x) - 3 * sd).alias("lower"),
                    F.when(const, None).otherwise(F.avg(x) + 3 * sd).alias("upper")]
        return _per_column(df, cols, fit).withColumn("_open", F.lit(True))
    raise ValueError(f"unknown outlier method: {method!r}")


def _flagged(df: DataFrame, bounds: DataFrame, cols: Sequence[str], order_key) -> DataFrame:
    """(column_name, value, _key) for every outlying cell; bounds are broadcast."""
    long = df.select(order_key.alias("_key"), *[clean_numeric(df, c).alias(c) for c in cols]) \
             .unpivot(["_key"], [qcol(c) for c in cols], "column_name", "value")
    j = long.join(F.broadcast(bounds.select("column_name", "lower", "upper")), "column_name")
    return j.where((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))


def outliers(df: DataFrame, method: str = "iqr",
             columns: Sequence[str] | None = None) -> DataFrame:
    """S7 / S8 summary: (column_name, n_outliers, pct_outliers, lower, upper) for
    the columns that have any outlier; pct is of the non-null values."""
    cols = numeric_columns(df, columns)
    if not cols:
        return _empty(df, "column_name string, n_outliers long, pct_outliers double, "
                          "lower double, upper double")
    bounds = outlier_bounds(df, method, cols)
    counts = _flagged(df, bounds, cols, F.lit(0)).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_outliers"))
    return (bounds.join(F.broadcast(counts), "column_name")
                  .select("column_name", "_ord", "n_outliers",
                          (F.col("n_outliers") * 100.0 / F.col("n_valid")).alias("pct_outliers"),
                          "lower", "upper")
                  .orderBy("_ord").drop("_ord"))


def outlier_examples(df: DataFrame, method: str = "iqr", columns: Sequence[str] | None = None,
                     order_by: Sequence[str] | None = None, limit: int = 10) -> DataFrame:
    """Up to ``limit`` outlying values per column, earliest in ``order_by`` order
    (table order when not given): (column_name, example_no, value)."""
    cols = numeric_columns(df, columns)
    if order_by:
        key = F.struct(*[qcol(c) for c in order_by])
    else:
        key = F.monotonically_increasing_id()
    flagged = _flagged(df, outlier_bounds(df, method, cols), cols, key)
    w = Window.partitionBy("column_name").orderBy("_key")
    return (flagged.withColumn("example_no", F.row_number().over(w))
                   .where(F.col("example_no") <= limit)
                   .select("column_name", "example_no", "value"))
