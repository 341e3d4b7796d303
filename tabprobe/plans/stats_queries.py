"""Registered statistics queries (S1, S2, S7, S8) and their SQL twins."""

from __future__ import annotations

from tabprobe.operators import stats
from tabprobe.plans.fixtures import A_SQL, D_SQL, customer_nulls, lineitem_nulls, rounded
from tabprobe.plans.registry import r6, register, union_sql
from tabprobe.session import table

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]


def _numeric_summary_sql(source: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        const = f"min({x}) = max({x})"
        parts.append(
            f"SELECT '{c}' AS column_name, count({x}) AS n, {r6(f'avg({x})')} AS mean, "
            f"{r6(f'stddev_samp({x})')} AS std, {r6(f'min({x})')} AS min, "
            f"{r6(f'quantile_cont({x}, 0.25)')} AS p25, {r6(f'quantile_cont({x}, 0.5)')} AS p50, "
            f"{r6(f'quantile_cont({x}, 0.75)')} AS p75, {r6(f'max({x})')} AS max, "
            f"{r6(f'CASE WHEN count({x}) < 3 THEN NULL WHEN {const} THEN 0.0 ELSE skewness({x}) END')} AS skewness, "
            f"{r6(f'CASE WHEN count({x}) < 4 THEN NULL WHEN {const} THEN 0.0 ELSE kurtosis({x}) END')} AS kurtosis "
            f"FROM {source}")
    return union_sql(parts)


@register("numeric_summary_lineitem", _numeric_summary_sql("lineitem", LINEITEM_NUMERIC))
def numeric_summary_lineitem(spark, sf):
    return rounded(stats.numeric_summary(table(spark, sf, "lineitem")))


@register("numeric_summary_lineitem_nulls", _numeric_summary_sql(A_SQL, ["l_discount", "l_tax"]))
def numeric_summary_lineitem_nulls(spark, sf):
    return rounded(stats.numeric_summary(lineitem_nulls(spark, sf), ["l_discount", "l_tax"]))


# ------------------------------------------------------------------ S2

def _catsummary_sql(source: str, cols: list[str], top: int = 5) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS column_name, a.n_distinct, m.v AS mode, m.n AS mode_count, a.n_missing,
  CAST(t.rank AS INTEGER) AS rank, t.v AS value, t.n AS value_count
FROM (SELECT CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct,
             CAST(count(*) - count({c}) AS BIGINT) AS n_missing FROM {source}) a
LEFT JOIN (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) AS rank
           FROM (SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1)) t
  ON t.rank <= {top}
LEFT JOIN (SELECT v, n FROM (SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1)
           ORDER BY n DESC, v LIMIT 1) m ON TRUE""")
    return union_sql(parts)


@register("categorical_summary_part", _catsummary_sql("part", ["p_name", "p_brand", "p_type"]))
def categorical_summary_part(spark, sf):
    return stats.categorical_summary(table(spark, sf, "part"))


@register("categorical_summary_customer_nulls", _catsummary_sql(D_SQL, ["c_name", "c_mktsegment"]))
def categorical_summary_customer_nulls(spark, sf):
    return stats.categorical_summary(customer_nulls(spark, sf))


# ------------------------------------------------------------------ S7 / S8

EVENT_NUMERIC = ["event_id", "user_id", "value"]


def _bounds_sql(source: str, c: str, method: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    if method == "iqr":
        return (f"SELECT '{c}' AS column_name, count({x}) AS n_valid, "
                f"quantile_cont({x}, 0.25) - 1.5 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) AS lower, "
                f"quantile_cont({x}, 0.75) + 1.5 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) AS upper "
                f"FROM {source}")
    return (f"SELECT '{c}' AS column_name, count({x}) AS n_valid, "
            f"CASE WHEN min({x}) = max({x}) THEN NULL ELSE avg({x}) - 3 * stddev_pop({x}) END AS lower, "
            f"CASE WHEN min({x}) = max({x}) THEN NULL ELSE avg({x}) + 3 * stddev_pop({x}) END AS upper "
            f"FROM {source}")


def _outliers_sql(source: str, cols: list[str], method: str) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT b.column_name, CAST(count(*) AS BIGINT) AS n_outliers,
  {r6('count(*) * 100.0 / max(b.n_valid)')} AS pct_outliers, {r6('max(b.lower)')} AS lower, {r6('max(b.upper)')} AS upper
FROM {source} s, ({_bounds_sql(source, c, method)}) b
WHERE CAST(s.{c} AS DOUBLE) < b.lower OR CAST(s.{c} AS DOUBLE) > b.upper GROUP BY b.column_name""")
    return union_sql(parts)


def _examples_sql(source: str, cols: list[str], method: str, order: str, limit: int = 10) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT column_name, CAST(example_no AS INTEGER) AS example_no, {r6('value')} AS value FROM (
  SELECT b.column_name, CAST(s.{c} AS DOUBLE) AS value, row_number() OVER (ORDER BY s.{order}) AS example_no
  FROM {source} s, ({_bounds_sql(source, c, method)}) b
  WHERE CAST(s.{c} AS DOUBLE) < b.lower OR CAST(s.{c} AS DOUBLE) > b.upper) WHERE example_no <= {limit}""")
    return union_sql(parts)


@register("outliers_iqr_events", _outliers_sql("events", EVENT_NUMERIC, "iqr"))
def outliers_iqr_events(spark, sf):
    return rounded(stats.outliers(table(spark, sf, "events"), "iqr"))


@register("outliers_zscore_events", _outliers_sql("events", EVENT_NUMERIC, "zscore"))
def outliers_zscore_events(spark, sf):
    return rounded(stats.outliers(table(spark, sf, "events"), "zscore"))


@register("outlier_examples_iqr_events", _examples_sql("events", EVENT_NUMERIC, "iqr", "event_id"))
def outlier_examples_iqr_events(spark, sf):
    return rounded(stats.outlier_examples(table(spark, sf, "events"), "iqr", order_by=["event_id"]))


@register("outlier_examples_zscore_events", _examples_sql("events", EVENT_NUMERIC, "zscore", "event_id"))
def outlier_examples_zscore_events(spark, sf):
    return rounded(stats.outlier_examples(table(spark, sf, "events"), "zscore", order_by=["event_id"]))


@register("outliers_iqr_lineitem_nulls", _outliers_sql(A_SQL, LINEITEM_NUMERIC, "iqr"))
def outliers_iqr_lineitem_nulls(spark, sf):
    return rounded(stats.outliers(lineitem_nulls(spark, sf), "iqr"))


@register("numeric_summary_events", _numeric_summary_sql("events", ["event_id", "user_id", "value"]))
def numeric_summary_events(spark, sf):
    return rounded(stats.numeric_summary(table(spark, sf, "events")))


@register("numeric_summary_orders", _numeric_summary_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"]))
def numeric_summary_orders(spark, sf):
    return rounded(stats.numeric_summary(table(spark, sf, "orders")))


@register("categorical_summary_documents", _catsummary_sql("documents", ["lang", "source"]))
def categorical_summary_documents(spark, sf):
    return stats.categorical_summary(table(spark, sf, "documents"), ["lang", "source"])


@register("categorical_summary_conversations", _catsummary_sql("conversations", ["role"]))
def categorical_summary_conversations(spark, sf):
    return stats.categorical_summary(table(spark, sf, "conversations"), ["role"])
