"""The aggregates behind each chart (V1-V10); drawing is not done here.

Only the binned / summarised rows leave the cluster. Bounds that a binning
needs (min, max) are one small aggregate; point sets are deterministic hash
samples with a cap, which is what a chart can show.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.functions.columns import clean_numeric, hash_order_key, numeric_columns, qcol
from tabprobe.functions.moments import pearson
from tabprobe.operators.quantiles import exact_quantiles, quantile_columns, quantiles_from_counts

SAMPLE_SEED = 42


def bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """1-based equal-width bin; the maximum falls in the last bin, a zero-width
    range puts everything in bin 1."""
    raw = F.floor(F.try_divide(x - lo, hi - lo) * F.lit(bins)) + 1
    return F.when(x.isNull(), None).otherwise(
        F.coalesce(F.least(F.greatest(raw, F.lit(1)), F.lit(bins)), F.lit(1)).cast("int"))


def histogram(df: DataFrame, column: str, bins: int = 20,
              by: str | None = None) -> DataFrame:
    """V1: (bin, lower, upper, n, mean, std) with exactly ``bins`` equal-width
    bins between min and max (empty bins included); ``by`` gives one histogram
    per group with its own range."""
    if bins < 1:
        raise ValueError("bins must be positive")
    x = clean_numeric(df, column)
    g = [qcol(by).alias("grp")] if by else [F.lit(None).cast("string").alias("grp")]
    vals = df.select(*g, x.alias("x")).where(F.col("x").isNotNull())
    stats = vals.groupBy("grp").agg(F.min("x").alias("lo"), F.max("x").alias("hi"),
                                    F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    bounds = stats.select(F.col("grp").alias("_sg"), "lo", "hi")
    # one row without groups; with groups the size is the group count: AQE decides
    bounds = F.broadcast(bounds) if not by else bounds
    binned = (vals.join(bounds, F.col("grp").eqNullSafe(F.col("_sg")))
                  .select("grp", bin_index(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin"))
                  .groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n")))
    grid = stats.select("grp", "lo", "hi", "mean", "std",
                        F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = binned.select(F.col("grp").alias("_bg"), F.col("bin").alias("_bb"), "n")
    out = (grid.join(binned, F.col("grp").eqNullSafe(F.col("_bg")) & (F.col("bin") == F.col("_bb")), "left")
               .select("grp", "bin",
                       (F.col("lo") + (F.col("bin") - 1) * width).alias("lower"),
                       F.when(F.col("bin") == bins, F.col("hi"))
                        .otherwise(F.col("lo") + F.col("bin") * width).alias("upper"),
                       F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean", "std"))
    if by:
        return out.withColumnRenamed("grp", by).orderBy(by, "bin")
    return out.drop("grp").orderBy("bin")


def box_stats(df: DataFrame, columns: Sequence[str] | str, by: str | None = None) -> DataFrame:
    """V2: q1, median, q3, whiskers (extreme values within 1.5 IQR of the box)
    and outlier count per numeric column (and per group when ``by`` is set)."""
    cols = [columns] if isinstance(columns, str) else numeric_columns(df, columns)
    if by:
        long = df.select(F.concat_ws("\u0001", F.lit(cols[0]), qcol(by).cast("string")).alias("column_name"),
                         clean_numeric(df, cols[0]).alias("x"), qcol(by).alias("_grp"))
    else:
        long = df.select(*[clean_numeric(df, c).alias(c) for c in cols]).unpivot(
            [], [qcol(c) for c in cols], "column_name", "x").withColumn("_grp", F.lit(None))
    long = long.where(F.col("x").isNotNull())
    if by:  # a data-dependent number of groups: the grouped quantile path
        vc = long.groupBy("column_name", F.col("x").alias("v")).agg(F.count(F.lit(1)).alias("c"))
        qs = quantiles_from_counts(vc, (0.25, 0.5, 0.75))
    else:
        qs = exact_quantiles(df, cols, (0.25, 0.5, 0.75))
    q = quantile_columns(qs, (0.25, 0.5, 0.75), ("q1", "median", "q3"))
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    j = long.join(q if by else F.broadcast(q), "column_name")  # one row per column, or per group
    agg = j.groupBy("column_name").agg(
        F.first("_grp").alias("_grp"),
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(F.col("x") >= lo_f, F.col("x"))).alias("lower_whisker"),
        F.max(F.when(F.col("x") <= hi_f, F.col("x"))).alias("upper_whisker"),
        F.count_if((F.col("x") < lo_f) | (F.col("x") > hi_f)).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))
    if by:
        return agg.select(F.col("_grp").alias(by), "q1", "median", "q3", "lower_whisker",
                          "upper_whisker", "n_outliers", "n").orderBy(by)
    return agg.drop("_grp")


def sample_key(id_cols: Sequence[str], seed: int = SAMPLE_SEED) -> Column:
    """Order of the point samples."""
    return hash_order_key(id_cols, seed)


def density_2d(df: DataFrame, x: str, y: str, x_bins: int = 50, y_bins: int = 50) -> DataFrame:
    """V3 for charts of any size: (x_bin, y_bin, n) over all complete points,
    ``x_bins`` by ``y_bins`` equal-width cells between each column's min and max
    (bins from 1; empty cells are left out), with the cells' lower corners."""
    pts = df.select(clean_numeric(df, x).alias("x"), clean_numeric(df, y).alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull())
    st = pts.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cells = (pts.crossJoin(F.broadcast(st))  # one row of bounds
                .select(bin_index(F.col("x"), F.col("x0"), F.col("x1"), x_bins).alias("x_bin"),
                        bin_index(F.col("y"), F.col("y0"), F.col("y1"), y_bins).alias("y_bin"), "x0", "x1", "y0", "y1"))
    n = cells.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("x0", "x1", "y0", "y1")])
    return n.select("x_bin", "y_bin", "n",
                    (F.col("x0") + (F.col("x_bin") - 1) * (F.col("x1") - F.col("x0")) / x_bins).alias("x_lower"),
                    (F.col("y0") + (F.col("y_bin") - 1) * (F.col("y1") - F.col("y0")) / y_bins).alias("y_lower"))


def scatter_points(df: DataFrame, x: str, y: str, color: str | None = None,
                   id_cols: Sequence[str] | None = None, max_points: int | None = None,
                   seed: int = SAMPLE_SEED) -> DataFrame:
    """V3: all (x, y[, color]) points with both coordinates present; when
    ``max_points`` is set, the points with the smallest hash keys (a
    deterministic sample, bounded per task by TakeOrdered)."""
    cols = [qcol(x).alias(x), qcol(y).alias(y)] + ([qcol(color).alias(color)] if color else [])
    pts = df.where(clean_numeric(df, x).isNotNull() & clean_numeric(df, y).isNotNull())
    if max_points is None:
        return pts.select(*cols)
    key = sample_key(id_cols or df.columns, seed)
    return pts.select(*cols, key.alias("_key")).orderBy("_key").limit(max_points).drop("_key")


def trend_line(df: DataFrame, x: str, y: str, points: int = 100) -> DataFrame:
    """V4: least-squares line over complete (x, y) pairs: ``points`` evenly
    spaced x between min and max of x, the fitted y, slope, intercept and r."""
    xs, ys = clean_numeric(df, x), clean_numeric(df, y)
    fit = df.select(xs.alias("x"), ys.alias("y")).agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        pearson(F.col("x"), F.col("y")).alias("r"),
        F.min("x").alias("lo"), F.max("x").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / F.lit(max(points - 1, 1))
    line = fit.withColumn("step_", step).select(
        "slope", "intercept", "r", "lo", "step_",
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    px = F.col("lo") + F.col("i") * F.col("step_")
    return line.select("i", px.alias("x"), (F.col("intercept") + F.col("slope") * px).alias("y_fit"),
                       "slope", "intercept", "r").orderBy("i")


def bar_counts(df: DataFrame, column: str) -> DataFrame:
    """V5: (value, n) for every non-null value, most frequent first."""
    c = qcol(column)
    return (df.where(c.isNotNull()).groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), F.col("value")))


def bar_means(df: DataFrame, x: str, y: str) -> DataFrame:
    """V6: mean of ``y`` per non-null ``x``, ordered by ``x``."""
    return (df.where(qcol(x).isNotNull()).groupBy(qcol(x).alias("value"))
              .agg(F.avg(clean_numeric(df, y)).alias("mean")).orderBy("value"))


def pie_shares(df: DataFrame, column: str, max_categories: int = 10) -> DataFrame:
    """V7: (value, n, share_pct, is_other). More than ``max_categories``
    categories -> the top ``max_categories - 1`` plus one "other" row (flagged,
    value NULL) holding the rest.

    The top rows come from a bounded TakeOrdered; the rest is one aggregate
    over an anti join with them -- no global window over all categories.
    """
    c = qcol(column)
    counts = (df.where(c.isNotNull()).groupBy(c.cast("string").alias("value"))
                .agg(F.count(F.lit(1)).alias("n")))
    head = counts.orderBy(F.col("n").desc(), F.col("value")).limit(max_categories - 1)
    rest = counts.join(F.broadcast(head.select("value")), "value", "left_anti").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.max("value").alias("value"))
    tail = rest.where(F.col("k") >= 1).select(
        F.when(F.col("k") == 1, F.col("value")).alias("value"), "n",
        (F.col("k") > 1).alias("is_other"))
    allrows = head.select("value", "n", F.lit(False).alias("is_other")).unionByName(tail)
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return (allrows.select("value", F.col("n").cast("long").alias("n"),
                           (F.col("n") * 100.0 / total).alias("share_pct"), "is_other")
                   .orderBy(F.col("is_other"), F.col("n").desc(), F.col("value")))


def pair_grid_histograms(df: DataFrame, columns: Sequence[str] | None = None,
                         bins: int = 20, max_columns: int = 5) -> DataFrame:
    """V8 diagonal: 20-bin histograms of up to five numeric columns, long form
    (column_name, bin, lower, upper, n)."""
    cols = numeric_columns(df, columns)[:max_columns]
    long = df.select(*[clean_numeric(df, c).alias(c) for c in cols]).unpivot(
        [], [qcol(c) for c in cols], "column_name", "x").where(F.col("x").isNotNull())
    stats = long.groupBy("column_name").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    binned = (long.join(F.broadcast(stats), "column_name")
                  .select("column_name", bin_index(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin"))
                  .groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("n")))
    grid = stats.select("column_name", "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return (grid.join(binned, ["column_name", "bin"], "left")
                .select("column_name", "bin",
                        (F.col("lo") + (F.col("bin") - 1) * width).alias("lower"),
                        F.when(F.col("bin") == bins, F.col("hi"))
                         .otherwise(F.col("lo") + F.col("bin") * width).alias("upper"),
                        F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def pair_grid_points(df: DataFrame, columns: Sequence[str] | None = None,
                     hue: str | None = None, id_cols: Sequence[str] | None = None,
                     max_points: int | None = None, max_columns: int = 5) -> DataFrame:
    """V8 off-diagonal: all rows (or one shared deterministic sample of
    ``max_points``) with the chosen columns and ``hue``; every panel plots two of them."""
    cols = numeric_columns(df, columns)[:max_columns]
    sel = [qcol(c) for c in cols] + ([qcol(hue)] if hue else [])
    if max_points is None:
        return df.select(*sel)
    key = sample_key(id_cols or df.columns)
    return df.select(*sel, key.alias("_key")).orderBy("_key").limit(max_points).drop("_key")


def distribution_by_group(df: DataFrame, column: str, group: str) -> DataFrame:
    """V10 (box part): per-group quartiles, whiskers and outlier counts."""
    return box_stats(df, column, by=group)


def density_by_group(df: DataFrame, column: str, group: str, grid_points: int = 64,
                     fine_bins: int = 256) -> DataFrame:
    """V10 (violin part): Gaussian kernel density per group on ``grid_points``
    points between the group's min and max, from ``fine_bins`` bin counts
    (binned KDE, bandwidth 1.059 * min(std, IQR / 1.349) * n^(-1/5)).

    Each group is reduced to at most ``fine_bins`` (center, count) pairs by a
    distributed aggregate; the density is evaluated with array functions on
    that bounded array, one row per group.
    """
    x = clean_numeric(df, column)
    vals = df.select(qcol(group).alias("grp"), x.alias("x")).where(F.col("x").isNotNull())
    box = box_stats(df, column, by=group).select(F.col(group).alias("grp"), "q1", "q3")
    st = vals.groupBy("grp").agg(F.min("x").alias("lo"), F.max("x").alias("hi"),
                                 F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"))
    st = st.join(box, "grp")
    bw = (F.lit(1.059) * F.least(F.coalesce(F.col("sd"), F.lit(0.0)),
                                 (F.col("q3") - F.col("q1")) / 1.349)
          * F.pow(F.col("n").cast("double"), -0.2))
    st = st.withColumn("h", F.when(bw > 0, bw).otherwise(
        F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / 10).otherwise(F.lit(1.0))))
    binned = (vals.join(st.select("grp", "lo", "hi"), "grp")
                  .select("grp", bin_index(F.col("x"), F.col("lo"), F.col("hi"), fine_bins).alias("b"))
                  .groupBy("grp", "b").agg(F.count(F.lit(1)).alias("c")))
    per = binned.groupBy("grp").agg(F.collect_list(F.struct("b", "c")).alias("bins"))
    j = per.join(st, "grp")
    width = (F.col("hi") - F.col("lo")) / fine_bins
    step = (F.col("hi") - F.col("lo")) / max(grid_points - 1, 1)
    pts = j.select("grp", "n", "h", "lo", "bins", width.alias("w"), step.alias("s"),
                   F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))).alias("i"))
    gx = F.col("lo") + F.col("i") * F.col("s")
    dens = F.aggregate(
        "bins", F.lit(0.0),
        lambda acc, e: acc + e["c"] * F.exp(
            -0.5 * F.pow((gx - (F.col("lo") + (e["b"] - 0.5) * F.col("w"))) / F.col("h"), 2)))
    return (pts.select(F.col("grp").alias(group), "i", gx.alias("x"),
                       (dens / (F.col("n") * F.col("h") * F.lit((2 * 3.141592653589793) ** 0.5)))
                       .alias("density"))
               .orderBy(group, "i"))
