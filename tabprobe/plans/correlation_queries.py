"""Registered correlation queries (S3-S6, V9) and their SQL twins."""

from __future__ import annotations

from itertools import combinations

from tabprobe.operators import correlation
from tabprobe.plans.fixtures import H_SQL, HA_SQL, price_lines, price_lines_nulls, rounded
from tabprobe.plans.registry import r6, register, union_sql
from tabprobe.session import table

H_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "net", "gross"]
HA_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "gross"]
PART_COLS = ["p_partkey", "p_size", "p_retailprice"]


def _complete(source, a, b):
    return (f"(SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {source} "
            f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


def _cell(method: str, source: str, a: str, b: str) -> str:
    t = _complete(source, a, b)
    if method == "pearson":
        return (f"SELECT CASE WHEN min(x) = max(x) OR min(y) = max(y) THEN NULL ELSE corr(y, x) END AS r "
                f"FROM {t}")
    if method == "spearman":
        ranked = (f"(SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS x, "
                  f"rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS y FROM {t})")
        return (f"SELECT CASE WHEN min(x) = max(x) OR min(y) = max(y) THEN NULL ELSE corr(y, x) END AS r "
                f"FROM {ranked}")
    if method == "kendall":
        ided = f"(SELECT row_number() OVER () AS id, x, y FROM {t})"
        return (f"SELECT CASE WHEN sum(CASE WHEN p.x <> q.x THEN 1 ELSE 0 END) = 0 "
                f"OR sum(CASE WHEN p.y <> q.y THEN 1 ELSE 0 END) = 0 THEN NULL ELSE "
                f"sum(sign((p.x - q.x) * (p.y - q.y))) / sqrt(CAST(sum(CASE WHEN p.x <> q.x THEN 1 ELSE 0 END) AS DOUBLE) "
                f"* sum(CASE WHEN p.y <> q.y THEN 1 ELSE 0 END)) END AS r "
                f"FROM {ided} p JOIN {ided} q ON p.id < q.id")
    raise ValueError(method)


def _diag_sql(method: str, source: str, c: str) -> str:
    if method == "kendall":
        return f"SELECT '{c}' AS col_a, '{c}' AS col_b, 1.0 AS r"
    return (f"SELECT '{c}' AS col_a, '{c}' AS col_b, CASE WHEN count({c}) > 1 AND min({c}) < max({c}) "
            f"THEN 1.0 END AS r FROM {source}")


def matrix_sql(method: str, source: str, cols: list[str]) -> str:
    parts = []
    for a, b in combinations(cols, 2):
        cell = _cell(method, source, a, b)
        parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, r FROM ({cell})")
        parts.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, r FROM ({cell})")
    parts += [_diag_sql(method, source, c) for c in cols]
    return f"SELECT col_a, col_b, {r6('r')} AS r FROM ({union_sql(parts)})"


def summary_sql(method: str, source: str, cols: list[str], threshold: float = 0.5) -> str:
    parts = [f"SELECT '{a}' AS col_a, '{b}' AS col_b, r FROM ({_cell(method, source, a, b)})"
             for a, b in combinations(cols, 2)]
    return (f"SELECT col_a, col_b, {r6('r')} AS r, CASE WHEN abs(r) >= 0.7 THEN 'strong' ELSE 'moderate' END "
            f"AS strength FROM ({union_sql(parts)}) WHERE r IS NOT NULL AND abs(r) >= {threshold}")


@register("corr_pearson_prices", matrix_sql("pearson", H_SQL, H_COLS))
def corr_pearson_prices(spark, sf):
    return rounded(correlation.corr_pearson(price_lines(spark, sf)))


@register("corr_pearson_prices_nulls", matrix_sql("pearson", HA_SQL, HA_COLS))
def corr_pearson_prices_nulls(spark, sf):
    return rounded(correlation.corr_pearson(price_lines_nulls(spark, sf)))


@register("corr_spearman_part", matrix_sql("spearman", "part", PART_COLS))
def corr_spearman_part(spark, sf):
    return rounded(correlation.corr_spearman(table(spark, sf, "part")))


@register("corr_spearman_prices_nulls", matrix_sql("spearman", HA_SQL, HA_COLS))
def corr_spearman_prices_nulls(spark, sf):
    return rounded(correlation.corr_spearman(price_lines_nulls(spark, sf)))


@register("corr_kendall_part", matrix_sql("kendall", "part", PART_COLS))
def corr_kendall_part(spark, sf):
    return rounded(correlation.corr_kendall(table(spark, sf, "part")))


@register("correlation_summary_prices", summary_sql("pearson", H_SQL, H_COLS))
def correlation_summary_prices(spark, sf):
    return rounded(correlation.strong_correlations(price_lines(spark, sf), "pearson", 0.5))


@register("correlation_summary_prices_spearman", summary_sql("spearman", HA_SQL, HA_COLS))
def correlation_summary_prices_spearman(spark, sf):
    return rounded(correlation.strong_correlations(price_lines_nulls(spark, sf), "spearman", 0.5))


@register("corr_heatmap_part_kendall", matrix_sql("kendall", "part", PART_COLS))
def corr_heatmap_part_kendall(spark, sf):
    return rounded(correlation.correlation_matrix(table(spark, sf, "part"), "kendall"))


@register("corr_kendall_prices_nulls")
def corr_kendall_prices_nulls(spark, sf):
    """Whole-table Kendall with missing values; the SQL self-join is quadratic
    here, so this one is checked against brute force in the unit tests."""
    return rounded(correlation.corr_kendall(price_lines_nulls(spark, sf)))
