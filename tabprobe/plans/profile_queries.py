"""Registered profiling queries (P1-P12) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabprobe.operators import positions, profile
from tabprobe.plans.fixtures import (A_SQL, B_SQL, C_SQL, D_SQL, customer_nulls, documents_labels,
                                     event_pairs, lineitem_nulls, rounded)
from tabprobe.plans.registry import r6, register, union_sql
from tabprobe.session import table

# ------------------------------------------------------------------ P1


@register("dataset_info_event_pairs", f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(2 AS BIGINT) AS n_columns,
  CAST(1 AS BIGINT) AS n_numeric, CAST(1 AS BIGINT) AS n_text,
  CAST(count(*) - count(event_type) + count(*) - count(user_id) AS BIGINT) AS missing_cells,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {C_SQL})) AS BIGINT) AS duplicate_rows
FROM {C_SQL}""")
def dataset_info_event_pairs(spark, sf):
    return profile.dataset_info(event_pairs(spark, sf))


@register("dataset_info_lineitem_nulls", f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(11 AS BIGINT) AS n_columns,
  CAST(8 AS BIGINT) AS n_numeric, CAST(2 AS BIGINT) AS n_text,
  CAST(count(*) - count(l_discount) + count(*) - count(l_tax) AS BIGINT) AS missing_cells,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {A_SQL})) AS BIGINT) AS duplicate_rows
FROM {A_SQL}""")
def dataset_info_lineitem_nulls(spark, sf):
    return profile.dataset_info(lineitem_nulls(spark, sf))


@register("column_kinds_lineitem", """
SELECT CAST(row_number() OVER (ORDER BY ordinal_position) - 1 AS INTEGER) AS ordinal, column_name,
  CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS data_type,
  CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT', 'SMALLINT') OR data_type LIKE 'DECIMAL%' THEN 'numeric'
    WHEN data_type = 'VARCHAR' THEN 'categorical' ELSE 'other' END AS kind
FROM information_schema.columns WHERE table_name = 'lineitem'""")
def column_kinds_lineitem(spark, sf):
    """The column list with types, as told by the table's schema."""
    return profile.column_kinds(table(spark, sf, "lineitem"))


# ------------------------------------------------------------------ P2

NUM_RE = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)\s*$"
# The same date layouts as profile.DATETIME_FORMATS, in strptime notation.
SQL_DATE_FORMATS = ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f",
                    "%Y-%m-%dT%H:%M:%S", "%Y/%m/%d", "%d.%m.%Y", "%m/%d/%Y")


def detect_sql(source: str, text_cols: list[str], typed: dict[str, str]) -> str:
    parts = []
    for c, label in typed.items():
        parts.append(f"SELECT '{c}' AS column_name, '{label}' AS detected_type")
    toks = "'true', 'false', 't', 'f', 'yes', 'no', 'y', 'n', '1', '0', '+', '-'"
    for c in text_cols:
        dt = " OR ".join(f"try_strptime({c}, '{f}') IS NOT NULL" for f in SQL_DATE_FORMATS)
        parts.append(f"""SELECT '{c}' AS column_name, CASE
  WHEN count({c}) = 0 OR bool_and(regexp_full_match({c}, '{NUM_RE}', 'i')) THEN 'numeric'
  WHEN bool_and({dt}) THEN 'datetime'
  WHEN count(DISTINCT lower({c})) <= 2 AND bool_and(lower({c}) IN ({toks})) THEN 'boolean'
  WHEN count(DISTINCT {c}) / count({c}) < 0.05 OR count(DISTINCT {c}) < 10 THEN 'categorical'
  ELSE 'text' END AS detected_type FROM {source}""")
    return union_sql(parts)


ORDERS_TEXT_SQL = """(SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
  o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority,
  CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS is_final FROM orders)"""


def orders_text(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus",
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority",
        F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("is_final"))


@register("detect_column_types_orders_text", detect_sql(
    ORDERS_TEXT_SQL, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                      "o_orderpriority", "is_final"], {}))
def detect_column_types_orders_text(spark, sf):
    return profile.detect_column_types(orders_text(spark, sf))


@register("detect_column_types_documents", detect_sql(
    "documents", ["text", "lang", "source"], {"doc_id": "numeric", "n_chars": "numeric"}))
def detect_column_types_documents(spark, sf):
    return profile.detect_column_types(table(spark, sf, "documents"))


# ------------------------------------------------------------------ P3

def suggest_sql(source: str, cols: list[str], numeric: list[str], text: list[str]) -> str:
    parts = []
    for c in cols:
        miss = f"(count(*) - count({c}))"
        parts.append(f"""SELECT 'high_missing' AS rule, '{c}' AS column_name,
  CAST({miss} AS DOUBLE) / count(*) AS value FROM {source} HAVING {miss} > 0 AND {miss} > count(*) * 0.5""")
        parts.append(f"""SELECT 'some_missing' AS rule, '{c}' AS column_name,
  CAST({miss} AS DOUBLE) / count(*) AS value FROM {source} HAVING {miss} > 0 AND {miss} <= count(*) * 0.5""")
        parts.append(f"""SELECT 'constant' AS rule, '{c}' AS column_name,
  CAST(count(DISTINCT {c}) AS DOUBLE) AS value FROM {source} HAVING count(DISTINCT {c}) <= 1""")
    for c in text:
        parts.append(f"""SELECT 'high_cardinality' AS rule, '{c}' AS column_name,
  CAST(count(DISTINCT {c}) AS DOUBLE) AS value FROM {source} HAVING count(DISTINCT {c}) > 10""")
    allc = ", ".join(cols)
    parts.append(f"""SELECT 'duplicates' AS rule, CAST(NULL AS VARCHAR) AS column_name,
  CAST(d AS DOUBLE) AS value FROM (SELECT (SELECT count(*) FROM {source}) -
  (SELECT count(*) FROM (SELECT DISTINCT {allc} FROM {source})) AS d) WHERE d > 0""")
    if len(numeric) > 1:
        ranges = union_sql([f"SELECT max({c}) - min({c}) AS rg FROM {source}" for c in numeric])
        parts.append(f"""SELECT 'scale' AS rule, CAST(NULL AS VARCHAR) AS column_name,
  CASE WHEN min(rg) = 0 THEN NULL ELSE max(rg) / min(rg) END AS value
  FROM ({ranges}) WHERE rg IS NOT NULL HAVING max(rg) > min(rg) * 100""")
    return union_sql(parts)


@register("suggest_preprocessing_lineitem_nulls", f"""SELECT rule, column_name, {r6('value')} AS value FROM (
{suggest_sql(A_SQL, ['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity',
                     'l_extendedprice', 'l_discount', 'l_tax', 'l_returnflag', 'l_linestatus', 'l_shipdate'],
             ['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice',
              'l_discount', 'l_tax'], ['l_returnflag', 'l_linestatus'])})""")
def suggest_preprocessing_lineitem_nulls(spark, sf):
    return rounded(profile.suggest_preprocessing(lineitem_nulls(spark, sf)))


@register("suggest_preprocessing_documents_labels", f"""SELECT rule, column_name, {r6('value')} AS value FROM (
{suggest_sql(B_SQL, ['doc_id', 'lang', 'source', 'n_chars', 'quality', 'toxic'],
             ['doc_id', 'n_chars', 'quality', 'toxic'], ['lang', 'source'])})""")
def suggest_preprocessing_documents_labels(spark, sf):
    return rounded(profile.suggest_preprocessing(documents_labels(spark, sf)))


# ------------------------------------------------------------------ P4

def _validate_sql() -> str:
    cells = f"(SELECT count(*) * 11 FROM {A_SQL})"
    miss = f"(SELECT count(*) - count(l_discount) + count(*) - count(l_tax) FROM {A_SQL})"
    pct = f"(CAST({miss} AS DOUBLE) * 100.0 / {cells})"
    typed = {"l_orderkey": "numeric", "l_partkey": "numeric", "l_suppkey": "numeric",
             "l_linenumber": "numeric", "l_quantity": "numeric", "l_extendedprice": "numeric",
             "l_discount": "numeric", "l_tax": "numeric", "l_shipdate": "datetime"}
    types = detect_sql(A_SQL, ["l_returnflag", "l_linestatus"], typed)
    return f"""SELECT level, rule, column_name, {r6('value')} AS value, detail FROM (
SELECT CASE WHEN {pct} > 80 THEN 'error' WHEN {pct} > 50 THEN 'warning' ELSE 'info' END AS level,
  'missing_cells_pct' AS rule, CAST(NULL AS VARCHAR) AS column_name, {pct} AS value,
  CAST(NULL AS VARCHAR) AS detail WHERE {pct} > 0
UNION ALL
SELECT 'info' AS level, 'detected_type' AS rule, column_name, CAST(NULL AS DOUBLE) AS value,
  detected_type AS detail FROM ({types}))"""


@register("validate_structure_lineitem_nulls", _validate_sql())
def validate_structure_lineitem_nulls(spark, sf):
    return rounded(profile.validate_structure(lineitem_nulls(spark, sf)))


# ------------------------------------------------------------------ P5 / P6

@register("missing_summary_lineitem_nulls", f"""
SELECT column_name, n_missing, {r6('n_missing * 100.0 / n_rows')} AS pct_missing FROM (
  SELECT 'l_discount' AS column_name, CAST(count(*) - count(l_discount) AS BIGINT) AS n_missing, count(*) AS n_rows FROM {A_SQL}
  UNION ALL
  SELECT 'l_tax', CAST(count(*) - count(l_tax) AS BIGINT), count(*) FROM {A_SQL})
WHERE n_missing > 0""")
def missing_summary_lineitem_nulls(spark, sf):
    return rounded(profile.missing_summary(lineitem_nulls(spark, sf)))


@register("missing_summary_documents_labels", f"""
SELECT column_name, n_missing, {r6('n_missing * 100.0 / n_rows')} AS pct_missing FROM (
  SELECT 'quality' AS column_name, CAST(count(*) - count(quality) AS BIGINT) AS n_missing, count(*) AS n_rows FROM {B_SQL}
  UNION ALL
  SELECT 'toxic', CAST(count(*) - count(toxic) AS BIGINT), count(*) FROM {B_SQL})
WHERE n_missing > 0""")
def missing_summary_documents_labels(spark, sf):
    return rounded(profile.missing_summary(documents_labels(spark, sf)))


LI_NO_TS = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
            "l_discount, l_tax, l_returnflag, l_linestatus")


@register("rows_with_missing_lineitem_nulls", f"""
SELECT {LI_NO_TS} FROM {A_SQL} WHERE l_discount IS NULL OR l_tax IS NULL""")
def rows_with_missing_lineitem_nulls(spark, sf):
    out = profile.rows_with_missing(lineitem_nulls(spark, sf), limit=None)
    return out.select(*[c.strip() for c in LI_NO_TS.split(",")])


# ------------------------------------------------------------------ P7 / P8

@register("duplicate_count_event_pairs", f"""
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {C_SQL})) AS BIGINT) AS n_duplicates
FROM {C_SQL}""")
def duplicate_count_event_pairs(spark, sf):
    return profile.duplicate_count(event_pairs(spark, sf))


@register("duplicate_count_lineitem", """
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT) AS n_duplicates
FROM lineitem""")
def duplicate_count_lineitem(spark, sf):
    return profile.duplicate_count(table(spark, sf, "lineitem"))


@register("duplicate_examples_event_pairs", f"""
SELECT e.event_type, e.user_id FROM {C_SQL} e
JOIN (SELECT event_type, user_id FROM {C_SQL} GROUP BY ALL HAVING count(*) > 1) d
  ON e.event_type IS NOT DISTINCT FROM d.event_type AND e.user_id IS NOT DISTINCT FROM d.user_id""")
def duplicate_examples_event_pairs(spark, sf):
    return profile.duplicate_examples(event_pairs(spark, sf), limit=None)


@register("duplicate_examples_event_pairs_first10", f"""
SELECT e.event_type, e.user_id FROM {C_SQL} e
JOIN (SELECT event_type, user_id FROM {C_SQL} GROUP BY ALL HAVING count(*) > 1) d
  ON e.event_type IS NOT DISTINCT FROM d.event_type AND e.user_id IS NOT DISTINCT FROM d.user_id
ORDER BY e.event_type, e.user_id LIMIT 10""")
def duplicate_examples_event_pairs_first10(spark, sf):
    return profile.duplicate_examples(event_pairs(spark, sf), limit=10, order_by=["event_type", "user_id"])


# ------------------------------------------------------------------ P9 - P11

@register("value_counts_top20_part_brand", """
SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL
GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 20""")
def value_counts_top20_part_brand(spark, sf):
    return profile.value_counts_topk(table(spark, sf, "part"), "p_brand", 20)


@register("value_counts_top10_customer_segment_nulls", f"""
SELECT c_mktsegment, count(*) AS n FROM {D_SQL} WHERE c_mktsegment IS NOT NULL
GROUP BY c_mktsegment ORDER BY n DESC, c_mktsegment LIMIT 10""")
def value_counts_top10_customer_segment_nulls(spark, sf):
    return profile.value_counts_topk(customer_nulls(spark, sf), "c_mktsegment", 10)


def _ranges_sql(source, cols):
    return union_sql([
        f"SELECT '{c}' AS column_name, {r6(f'min({c})')} AS min, {r6(f'max({c})')} AS max, "
        f"{r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std FROM {source}" for c in cols])


@register("numeric_ranges_part", _ranges_sql("part", ["p_partkey", "p_size", "p_retailprice"]))
def numeric_ranges_part(spark, sf):
    return rounded(profile.numeric_ranges(table(spark, sf, "part")))


@register("numeric_ranges_lineitem_nulls", _ranges_sql(
    A_SQL, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax"]))
def numeric_ranges_lineitem_nulls(spark, sf):
    return rounded(profile.numeric_ranges(lineitem_nulls(spark, sf)))


def _catinfo_sql(source, cols):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS column_name,
  (SELECT CAST(count(DISTINCT {c}) AS BIGINT) FROM {source}) AS n_distinct,
  (SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1
                  ORDER BY n DESC, v LIMIT 1)) AS most_frequent,
  (SELECT CAST(count(*) - count({c}) AS BIGINT) FROM {source}) AS n_missing""")
    return union_sql(parts)


@register("categorical_info_customer_nulls", _catinfo_sql(D_SQL, ["c_name", "c_mktsegment"]))
def categorical_info_customer_nulls(spark, sf):
    return profile.categorical_info(customer_nulls(spark, sf))


@register("categorical_info_part", _catinfo_sql("part", ["p_name", "p_brand", "p_type"]))
def categorical_info_part(spark, sf):
    return profile.categorical_info(table(spark, sf, "part"))


# ------------------------------------------------------------------ P12

@register("page_rows_orders_p3_s100", """
SELECT o_orderkey, o_custkey, o_totalprice, row_id FROM (
  SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders)
WHERE row_id BETWEEN 200 AND 299""")
def page_rows_orders_p3_s100(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return positions.page_rows(o, 3, 100, order_by=["o_orderkey"])


@register("page_rows_orders_clamped", """
SELECT o_orderkey, o_custkey, o_totalprice, row_id FROM (
  SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders)
WHERE row_id >= ((SELECT count(*) FROM orders) + 999) // 1000 * 1000 - 1000""")
def page_rows_orders_clamped(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return positions.page_rows(o, 10**9, 1000, order_by=["o_orderkey"])


@register("duplicate_count_document_texts", """
SELECT CAST(count(*) - count(DISTINCT text) AS BIGINT) AS n_duplicates FROM documents""")
def duplicate_count_document_texts(spark, sf):
    """Whole texts compared: exact copies among the documents."""
    return profile.duplicate_count(table(spark, sf, "documents").select("text"))


@register("detect_column_types_conversations", detect_sql(
    "conversations", ["role", "text"], {"conv_id": "numeric", "turn": "numeric"}))
def detect_column_types_conversations(spark, sf):
    return profile.detect_column_types(table(spark, sf, "conversations"))


@register("detect_column_types_pages", detect_sql("pages", ["url", "html"], {"page_id": "numeric"}))
def detect_column_types_pages(spark, sf):
    return profile.detect_column_types(table(spark, sf, "pages"))


@register("dataset_info_documents_labels", f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(6 AS BIGINT) AS n_columns,
  CAST(4 AS BIGINT) AS n_numeric, CAST(2 AS BIGINT) AS n_text,
  CAST(count(*) - count(quality) + count(*) - count(toxic) AS BIGINT) AS missing_cells,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {B_SQL})) AS BIGINT) AS duplicate_rows
FROM {B_SQL}""")
def dataset_info_documents_labels(spark, sf):
    return profile.dataset_info(documents_labels(spark, sf))


@register("value_counts_top20_event_types", """
SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL
GROUP BY event_type ORDER BY n DESC, event_type LIMIT 20""")
def value_counts_top20_event_types(spark, sf):
    return profile.value_counts_topk(table(spark, sf, "events"), "event_type", 20)


@register("rows_with_missing_documents_labels", f"""
SELECT doc_id, lang, source, n_chars, quality, toxic FROM {B_SQL} WHERE quality IS NULL OR toxic IS NULL""")
def rows_with_missing_documents_labels(spark, sf):
    return profile.rows_with_missing(documents_labels(spark, sf), limit=None)
