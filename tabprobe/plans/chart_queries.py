"""Registered chart-data queries (V1-V10) and their SQL twins."""

from __future__ import annotations

from tabprobe.operators import chartdata
from tabprobe.plans.fixtures import H_SQL, price_lines, rounded
from tabprobe.plans.registry import r6, register, union_sql
from tabprobe.session import table


def _hist_sql(source: str, col: str, bins: int, by: str | None = None) -> str:
    g = f"{by}" if by else "CAST(NULL AS VARCHAR)"
    sel_g = f"s.g AS {by}, " if by else ""
    return f"""
WITH v AS (SELECT {g} AS g, CAST({col} AS DOUBLE) AS x FROM {source} WHERE {col} IS NOT NULL),
s AS (SELECT g, min(x) AS lo, max(x) AS hi, avg(x) AS mean, stddev_samp(x) AS std FROM v GROUP BY g),
b AS (SELECT v.g, CAST(COALESCE(least(greatest(floor((v.x - s.lo) / (s.hi - s.lo) * {bins}) + 1, 1), {bins}), 1)
             AS INTEGER) AS bin, count(*) AS n
      FROM v JOIN s ON v.g IS NOT DISTINCT FROM s.g GROUP BY 1, 2),
k AS (SELECT CAST(range + 1 AS INTEGER) AS bin FROM range({bins}))
SELECT {sel_g}k.bin AS bin, {r6(f's.lo + (k.bin - 1) * ((s.hi - s.lo) / {bins})')} AS lower,
  {r6(f'CASE WHEN k.bin = {bins} THEN s.hi ELSE s.lo + k.bin * ((s.hi - s.lo) / {bins}) END')} AS upper,
  CAST(COALESCE(b.n, 0) AS BIGINT) AS n, {r6('s.mean')} AS mean, {r6('s.std')} AS std
FROM s CROSS JOIN k LEFT JOIN b ON b.g IS NOT DISTINCT FROM s.g AND b.bin = k.bin"""


@register("histogram_events_value", _hist_sql("events", "value", 20))
def histogram_events_value(spark, sf):
    return rounded(chartdata.histogram(table(spark, sf, "events"), "value", 20))


@register("histogram_events_value_by_type", _hist_sql("events", "value", 10, "event_type"))
def histogram_events_value_by_type(spark, sf):
    return rounded(chartdata.histogram(table(spark, sf, "events"), "value", 10, by="event_type"))


def _box_sql(source: str, col: str, by: str | None = None) -> str:
    g = by if by else f"'{col}'"
    out_g = f"q.g AS {by}" if by else "q.g AS column_name"
    return f"""
WITH v AS (SELECT {g} AS g, CAST({col} AS DOUBLE) AS x FROM {source} WHERE {col} IS NOT NULL),
q AS (SELECT g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3
      FROM v GROUP BY g)
SELECT {out_g}, {r6('q.q1')} AS q1, {r6('q.med')} AS median, {r6('q.q3')} AS q3,
  {r6('min(CASE WHEN v.x >= q.q1 - 1.5 * (q.q3 - q.q1) THEN v.x END)')} AS lower_whisker,
  {r6('max(CASE WHEN v.x <= q.q3 + 1.5 * (q.q3 - q.q1) THEN v.x END)')} AS upper_whisker,
  count(*) FILTER (WHERE v.x < q.q1 - 1.5 * (q.q3 - q.q1) OR v.x > q.q3 + 1.5 * (q.q3 - q.q1)) AS n_outliers,
  count(*) AS n
FROM v JOIN q ON v.g = q.g GROUP BY q.g, q.q1, q.med, q.q3"""


@register("box_stats_events_value", _box_sql("events", "value"))
def box_stats_events_value(spark, sf):
    return rounded(chartdata.box_stats(table(spark, sf, "events"), "value"))


@register("box_stats_part_all", union_sql([f"SELECT * FROM ({_box_sql('part', c)})" for c in ("p_partkey", "p_size", "p_retailprice")]))
def box_stats_part_all(spark, sf):
    return rounded(chartdata.box_stats(table(spark, sf, "part"), None))


@register("distribution_by_group_events", _box_sql("events", "value", "event_type"))
def distribution_by_group_events(spark, sf):
    return rounded(chartdata.distribution_by_group(table(spark, sf, "events"), "value", "event_type"))


@register("density_by_group_events", f"""
WITH v AS (SELECT event_type AS g, value AS x FROM events WHERE value IS NOT NULL),
s AS (SELECT g, min(x) AS lo, max(x) AS hi, count(*) AS n, coalesce(stddev_samp(x), 0) AS sd,
             (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.349 AS iq FROM v GROUP BY g),
h AS (SELECT *, CASE WHEN least(sd, iq) > 0 THEN 1.059 * least(sd, iq) * pow(n, -0.2)
                     WHEN hi > lo THEN (hi - lo) / 10 ELSE 1.0 END AS h FROM s),
b AS (SELECT v.g, least(greatest(floor((x - lo) / (hi - lo) * 256) + 1, 1), 256) AS b, count(*) AS c
      FROM v JOIN h ON v.g = h.g GROUP BY 1, 2),
p AS (SELECT h.*, CAST(i AS INTEGER) AS i, lo + i * (hi - lo) / 63 AS gx FROM h, range(64) r(i))
SELECT p.g AS event_type, i, {r6('any_value(gx)')} AS x,
  {r6('sum(c * exp(-0.5 * pow((gx - (lo + (b - 0.5) * (hi - lo) / 256)) / h, 2))) / any_value(n * h * sqrt(2 * pi()))')} AS density
FROM p JOIN b ON p.g = b.g GROUP BY p.g, i""")
def density_by_group_events(spark, sf):
    """Violin density (binned Gaussian KDE)."""
    return rounded(chartdata.density_by_group(table(spark, sf, "events"), "value", "event_type"))


@register("scatter_points_orders", """
SELECT o_totalprice, o_custkey FROM orders WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL""")
def scatter_points_orders(spark, sf):
    o = table(spark, sf, "orders")
    return rounded(chartdata.scatter_points(o, "o_totalprice", "o_custkey"))


@register("scatter_points_lineitem_colored", """
SELECT l_extendedprice, l_quantity, l_returnflag FROM lineitem""")
def scatter_points_lineitem_colored(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(chartdata.scatter_points(li, "l_extendedprice", "l_quantity", "l_returnflag"))


@register("density_2d_lineitem", f"""
WITH b AS (SELECT min(l_extendedprice) AS x0, max(l_extendedprice) AS x1, min(l_quantity) AS y0, max(l_quantity) AS y1 FROM lineitem),
c AS (SELECT least(greatest(CAST(floor((l_extendedprice - x0) / (x1 - x0) * 40) AS INTEGER) + 1, 1), 40) AS x_bin,
             least(greatest(CAST(floor((l_quantity - y0) / (y1 - y0) * 25) AS INTEGER) + 1, 1), 25) AS y_bin FROM lineitem, b)
SELECT x_bin, y_bin, count(*) AS n, {r6('any_value(x0) + (x_bin - 1) * (any_value(x1) - any_value(x0)) / 40')} AS x_lower,
  {r6('any_value(y0) + (y_bin - 1) * (any_value(y1) - any_value(y0)) / 25')} AS y_lower
FROM c, b GROUP BY x_bin, y_bin""")
def density_2d_lineitem(spark, sf):
    return rounded(chartdata.density_2d(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", 40, 25))


@register("trend_line_prices", f"""
WITH f AS (SELECT regr_slope(net, l_extendedprice) AS slope, regr_intercept(net, l_extendedprice) AS intercept,
                  CASE WHEN min(CASE WHEN net IS NOT NULL THEN l_extendedprice END)
                            = max(CASE WHEN net IS NOT NULL THEN l_extendedprice END)
                         OR min(CASE WHEN l_extendedprice IS NOT NULL THEN net END)
                            = max(CASE WHEN l_extendedprice IS NOT NULL THEN net END)
                       THEN NULL ELSE corr(net, l_extendedprice) END AS r,
                  min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM {H_SQL})
SELECT CAST(range AS INTEGER) AS i, {r6('lo + range * ((hi - lo) / 99)')} AS x,
  {r6('intercept + slope * (lo + range * ((hi - lo) / 99))')} AS y_fit,
  {r6('slope')} AS slope, {r6('intercept')} AS intercept, {r6('r')} AS r
FROM f CROSS JOIN range(100)""")
def trend_line_prices(spark, sf):
    return rounded(chartdata.trend_line(price_lines(spark, sf), "l_extendedprice", "net"))


@register("bar_counts_part_type", """
SELECT p_type AS value, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1""")
def bar_counts_part_type(spark, sf):
    return chartdata.bar_counts(table(spark, sf, "part"), "p_type")


@register("bar_means_lineitem_flag", f"""
SELECT l_returnflag AS value, {r6('avg(l_extendedprice)')} AS mean FROM lineitem
WHERE l_returnflag IS NOT NULL GROUP BY 1""")
def bar_means_lineitem_flag(spark, sf):
    return rounded(chartdata.bar_means(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"))


def _pie_sql(source: str, col: str, max_categories: int = 10) -> str:
    return f"""
WITH c AS (SELECT CAST({col} AS VARCHAR) AS v, count(*) AS n FROM {source} WHERE {col} IS NOT NULL GROUP BY 1),
h AS (SELECT v, n FROM c ORDER BY n DESC, v LIMIT {max_categories - 1}),
r AS (SELECT count(*) AS k, sum(n) AS n, max(v) AS v FROM c WHERE v NOT IN (SELECT v FROM h)),
a AS (SELECT v AS value, n, false AS is_other FROM h
      UNION ALL SELECT CASE WHEN k = 1 THEN v END, n, k > 1 FROM r WHERE k >= 1)
SELECT value, CAST(n AS BIGINT) AS n, {r6('n * 100.0 / sum(n) OVER ()')} AS share_pct, is_other FROM a"""


@register("pie_shares_part_brand", _pie_sql("part", "p_brand"))
def pie_shares_part_brand(spark, sf):
    return rounded(chartdata.pie_shares(table(spark, sf, "part"), "p_brand"))


@register("pie_shares_part_type", _pie_sql("part", "p_type"))
def pie_shares_part_type(spark, sf):
    return rounded(chartdata.pie_shares(table(spark, sf, "part"), "p_type"))


PAIR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pair_hist_sql() -> str:
    parts = []
    for c in PAIR_COLS:
        parts.append(f"SELECT '{c}' AS column_name, bin, lower, upper, n FROM ({_hist_sql('lineitem', c, 20)})")
    return union_sql(parts)


@register("pair_grid_histograms_lineitem", _pair_hist_sql())
def pair_grid_histograms_lineitem(spark, sf):
    return rounded(chartdata.pair_grid_histograms(table(spark, sf, "lineitem"), PAIR_COLS))


@register("pair_grid_points_orders", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders""")
def pair_grid_points_orders(spark, sf):
    o = table(spark, sf, "orders")
    return rounded(chartdata.pair_grid_points(o, ["o_orderkey", "o_custkey", "o_totalprice"],
                                              hue="o_orderstatus"))


@register("histogram_lineitem_price_30", _hist_sql("lineitem", "l_extendedprice", 30))
def histogram_lineitem_price_30(spark, sf):
    return rounded(chartdata.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 30))


@register("bar_counts_document_sources", """
SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1""")
def bar_counts_document_sources(spark, sf):
    return chartdata.bar_counts(table(spark, sf, "documents"), "source")


@register("pie_shares_document_sources", _pie_sql("documents", "source"))
def pie_shares_document_sources(spark, sf):
    return rounded(chartdata.pie_shares(table(spark, sf, "documents"), "source"))
