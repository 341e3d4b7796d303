"""Registered row / column / value queries (T0-T19) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabprobe.operators import clean, positions, scale_encode
from tabprobe.operators.ordering import with_row_id
from tabprobe.plans.fixtures import (A_SQL, B_SQL, C_SQL, D_SQL, customer_nulls, documents_labels,
                                     event_pairs, lineitem_nulls, rounded)
from tabprobe.plans.registry import r6, register
from tabprobe.session import table

ORD = "o_orderkey, o_custkey, o_totalprice"
LI = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
      "l_discount, l_tax, l_returnflag, l_linestatus")
LI_COLS = [c.strip() for c in LI.split(",")]
CUST = "c_custkey, c_name, c_nationkey, c_acctbal"


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


RID = f"(SELECT {ORD}, row_number() OVER (ORDER BY o_orderkey) - 1 AS rid FROM orders)"

# ------------------------------------------------------------------ T0-T3


@register("row_id_orders", f"SELECT {ORD}, rid AS row_id FROM {RID}")
def row_id_orders(spark, sf):
    return with_row_id(_orders(spark, sf), ["o_orderkey"])


@register("row_id_lineitem_composite_key", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS row_id FROM lineitem""")
def row_id_lineitem_composite_key(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return with_row_id(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@register("row_id_lineitem_tied_key", """
SELECT l_returnflag, count(*) AS n, min(row_id) AS first_id, max(row_id) AS last_id FROM (
  SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) - 1 AS row_id FROM lineitem)
GROUP BY l_returnflag""")
def row_id_lineitem_tied_key(spark, sf):
    """Heavily tied key (three values): ids stay contiguous per key value."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey")
    ided = with_row_id(li, ["l_returnflag"])
    return ided.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_id"),
                                            F.max("row_id").alias("last_id"))


@register("remove_rows_by_index_orders", f"""
SELECT {ORD}, row_number() OVER (ORDER BY rid) - 1 AS row_id FROM {RID}
WHERE NOT (rid = 1 OR rid BETWEEN 3 AND 5 OR rid = 7 OR rid = 20000000)""")
def remove_rows_by_index_orders(spark, sf):
    return positions.remove_rows_by_index(_orders(spark, sf), "1,3-5,7,20000000", order_by=["o_orderkey"])


@register("keep_rows_by_index_orders", f"""
SELECT {ORD}, row_number() OVER (ORDER BY rid) - 1 AS row_id FROM {RID}
WHERE rid BETWEEN 10 AND 19 OR rid = 5 OR rid BETWEEN 400 AND 402""")
def keep_rows_by_index_orders(spark, sf):
    return positions.keep_rows_by_index(_orders(spark, sf), "10-19, 5, 400-402", order_by=["o_orderkey"])


@register("keep_rows_by_index_orders_none_valid", f"SELECT {ORD}, rid AS row_id FROM {RID}")
def keep_rows_by_index_orders_none_valid(spark, sf):
    return positions.keep_rows_by_index(_orders(spark, sf), "50000000-50000010", order_by=["o_orderkey"])


@register("preview_rows_by_index_orders", f"""
SELECT {ORD}, rid AS row_id FROM {RID} WHERE rid BETWEEN 10 AND 19 OR rid = 5""")
def preview_rows_by_index_orders(spark, sf):
    return positions.preview_rows_by_index(_orders(spark, sf), "10-19,5", order_by=["o_orderkey"])


# ------------------------------------------------------------------ T19

@register("apply_edits_orders", """
SELECT o_orderkey,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
  o_orderpriority, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders""")
def apply_edits_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    base = with_row_id(o, ["o_orderkey"])
    edits = base.where(F.col("o_orderpriority") == "1-URGENT").select(
        "row_id", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return positions.apply_edits(base, edits)


# ------------------------------------------------------------------ T4 / T5

@register("remove_rows_by_value_lineitem_flag", f"SELECT {LI} FROM lineitem WHERE l_returnflag <> 'R'")
def remove_rows_by_value_lineitem_flag(spark, sf):
    return clean.remove_rows_by_value(table(spark, sf, "lineitem").select(*LI_COLS), "l_returnflag", "R")


@register("remove_rows_by_value_lineitem_quantity", f"SELECT {LI} FROM lineitem WHERE l_quantity <> 5.0")
def remove_rows_by_value_lineitem_quantity(spark, sf):
    return clean.remove_rows_by_value(table(spark, sf, "lineitem").select(*LI_COLS), "l_quantity", "5.0")


@register("remove_rows_by_value_lineitem_noncanonical", f"SELECT {LI} FROM lineitem")
def remove_rows_by_value_lineitem_noncanonical(spark, sf):
    """'5' is not the text of any double (5.0 prints as '5.0'): nothing matches."""
    return clean.remove_rows_by_value(table(spark, sf, "lineitem").select(*LI_COLS), "l_quantity", "5")


@register("keep_rows_by_value_orders_status", f"SELECT {ORD}, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def keep_rows_by_value_orders_status(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return clean.keep_rows_by_value(o, "o_orderstatus", "F")


@register("keep_rows_by_value_orders_no_match", f"SELECT {ORD}, o_orderstatus FROM orders")
def keep_rows_by_value_orders_no_match(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return clean.keep_rows_by_value(o, "o_orderstatus", "nope")


@register("keep_rows_by_value_customer_nan", f"SELECT {CUST}, c_mktsegment FROM {D_SQL} WHERE c_mktsegment IS NULL")
def keep_rows_by_value_customer_nan(spark, sf):
    return rounded(clean.keep_rows_by_value(customer_nulls(spark, sf), "c_mktsegment", "nan"))


# ------------------------------------------------------------------ T6 / T7

@register("drop_columns_orders", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def drop_columns_orders(spark, sf):
    return clean.drop_columns(table(spark, sf, "orders"), ["o_comment", "o_orderdate", 1])


@register("replace_values_part", """
SELECT p_partkey, CASE WHEN p_brand = 'Brand#13' THEN 'Brand#X' ELSE p_brand END AS p_brand,
  CASE WHEN p_size = 7 THEN 70 ELSE p_size END AS p_size, p_retailprice FROM part""")
def replace_values_part(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    p = clean.replace_values(p, "p_brand", "Brand#13", "Brand#X")
    return clean.replace_values(p, "p_size", "7", "70")


@register("replace_values_part_widen", """
SELECT p_partkey, CASE WHEN p_size = 7 THEN 'seven' ELSE CAST(p_size AS VARCHAR) END AS p_size FROM part""")
def replace_values_part_widen(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    return clean.replace_values(p, "p_size", "7", "seven")


@register("replace_values_customer_missing", f"""
SELECT {CUST}, COALESCE(c_mktsegment, 'UNKNOWN') AS c_mktsegment FROM {D_SQL}""")
def replace_values_customer_missing(spark, sf):
    return rounded(clean.replace_values(customer_nulls(spark, sf), "c_mktsegment", "nan", "UNKNOWN"))


# ------------------------------------------------------------------ T8-T13

@register("drop_rows_missing_lineitem_nulls", f"""
SELECT {LI} FROM {A_SQL} WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL""")
def drop_rows_missing_lineitem_nulls(spark, sf):
    return clean.drop_rows_missing(lineitem_nulls(spark, sf).select(*LI_COLS))


@register("drop_columns_missing_documents_labels", "SELECT doc_id, lang, source, n_chars FROM documents")
def drop_columns_missing_documents_labels(spark, sf):
    return clean.drop_columns_missing(documents_labels(spark, sf))


@register("fill_mean_documents_labels", f"""
SELECT doc_id, lang, source, n_chars,
  {r6(f'COALESCE(CAST(quality AS DOUBLE), (SELECT avg(quality) FROM {B_SQL}))')} AS quality,
  {r6(f'COALESCE(CAST(toxic AS DOUBLE), (SELECT avg(toxic) FROM {B_SQL}))')} AS toxic FROM {B_SQL}""")
def fill_mean_documents_labels(spark, sf):
    return rounded(clean.fill_mean(documents_labels(spark, sf)))


@register("fill_mean_lineitem_nulls", f"""
SELECT l_orderkey, l_linenumber,
  {r6(f'COALESCE(l_discount, (SELECT avg(l_discount) FROM {A_SQL}))')} AS l_discount,
  {r6(f'COALESCE(l_tax, (SELECT avg(l_tax) FROM {A_SQL}))')} AS l_tax FROM {A_SQL}""")
def fill_mean_lineitem_nulls(spark, sf):
    li = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return rounded(clean.fill_mean(li))


@register("fill_median_lineitem_nulls", f"""
SELECT l_orderkey, l_linenumber,
  {r6(f'COALESCE(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM {A_SQL}))')} AS l_discount,
  {r6(f'COALESCE(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM {A_SQL}))')} AS l_tax FROM {A_SQL}""")
def fill_median_lineitem_nulls(spark, sf):
    li = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return rounded(clean.fill_median(li))


def _mode_sql(source, c):
    return (f"(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL "
            f"GROUP BY 1 ORDER BY n DESC, v LIMIT 1))")


@register("fill_mode_customer_nulls", f"""
SELECT {CUST}, COALESCE(c_mktsegment, {_mode_sql(D_SQL, 'c_mktsegment')}) AS c_mktsegment FROM {D_SQL}""")
def fill_mode_customer_nulls(spark, sf):
    return rounded(clean.fill_mode(customer_nulls(spark, sf)))


@register("fill_mode_documents_labels", f"""
SELECT doc_id, lang, source, n_chars, COALESCE(quality, {_mode_sql(B_SQL, 'quality')}) AS quality,
  COALESCE(toxic, {_mode_sql(B_SQL, 'toxic')}) AS toxic FROM {B_SQL}""")
def fill_mode_documents_labels(spark, sf):
    return clean.fill_mode(documents_labels(spark, sf))


@register("fill_mean_customer_text_mode", f"""
SELECT {CUST}, COALESCE(c_mktsegment, {_mode_sql(D_SQL, 'c_mktsegment')}) AS c_mktsegment FROM {D_SQL}""")
def fill_mean_customer_text_mode(spark, sf):
    """Mean filling on a text column falls back to the mode."""
    return rounded(clean.fill_mean(customer_nulls(spark, sf)))


@register("fill_zero_documents_labels", f"""
SELECT doc_id, lang, source, n_chars, COALESCE(quality, 0) AS quality, COALESCE(toxic, 0) AS toxic FROM {B_SQL}""")
def fill_zero_documents_labels(spark, sf):
    return clean.fill_zero(documents_labels(spark, sf))


@register("fill_zero_customer_nulls", f"SELECT {CUST}, COALESCE(c_mktsegment, '') AS c_mktsegment FROM {D_SQL}")
def fill_zero_customer_nulls(spark, sf):
    return rounded(clean.fill_zero(customer_nulls(spark, sf)))


# ------------------------------------------------------------------ T14

@register("drop_duplicates_event_pairs", f"SELECT DISTINCT event_type, user_id FROM {C_SQL}")
def drop_duplicates_event_pairs(spark, sf):
    return clean.drop_duplicates(event_pairs(spark, sf))


@register("drop_duplicates_event_pairs_first", f"""
SELECT event_type, user_id, min(row_id) AS row_id FROM (
  SELECT event_type, user_id, row_number() OVER (ORDER BY event_id) - 1 AS row_id FROM events)
GROUP BY event_type, user_id""")
def drop_duplicates_event_pairs_first(spark, sf):
    ev = with_row_id(table(spark, sf, "events"), ["event_id"]).select("event_type", "user_id", "row_id")
    return clean.drop_duplicates(ev, row_id="row_id")


# ------------------------------------------------------------------ T15 / T16

def _scale_sql(method: str) -> str:
    cols = ["l_quantity", "l_discount", "l_tax"]
    ok = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    ok_s = " AND ".join(f"s.{c} IS NOT NULL" for c in cols)
    fit = ", ".join(
        (f"min({c}) AS a_{c}, max({c}) AS b_{c}" if method == "minmax"
         else f"avg({c}) AS a_{c}, stddev_pop({c}) AS b_{c}, min({c}) = max({c}) AS k_{c}")
        for c in cols)
    exprs = []
    for c in cols:
        if method == "minmax":
            sc = f"CASE WHEN f.b_{c} = f.a_{c} THEN 0.0 ELSE (s.{c} - f.a_{c}) / (f.b_{c} - f.a_{c}) END"
        else:
            sc = f"CASE WHEN f.k_{c} OR f.b_{c} = 0 THEN 0.0 ELSE (s.{c} - f.a_{c}) / f.b_{c} END"
        exprs.append(f"{r6(f'CASE WHEN {ok_s} THEN {sc} ELSE s.{c} END')} AS {c}")
    return (f"SELECT s.l_orderkey, s.l_linenumber, {', '.join(exprs)} FROM {A_SQL} s, "
            f"(SELECT {fit} FROM {A_SQL} WHERE {ok}) f")


@register("scale_minmax_lineitem_nulls", _scale_sql("minmax"))
def scale_minmax_lineitem_nulls(spark, sf):
    li = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return rounded(scale_encode.scale_minmax(li, ["l_quantity", "l_discount", "l_tax"]))


@register("scale_standard_lineitem_nulls", _scale_sql("standard"))
def scale_standard_lineitem_nulls(spark, sf):
    li = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return rounded(scale_encode.scale_standard(li, ["l_quantity", "l_discount", "l_tax"]))


# ------------------------------------------------------------------ T17 / T18

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "nan")
ONEHOT_COLS = ", ".join(f"COALESCE(c_mktsegment, 'nan') = '{v}' AS \"c_mktsegment_{v}\"" for v in SEGMENTS)


@register("encode_onehot_customer_nulls", f"SELECT {CUST}, {ONEHOT_COLS} FROM {D_SQL}")
def encode_onehot_customer_nulls(spark, sf):
    return rounded(scale_encode.encode_onehot(customer_nulls(spark, sf), ["c_mktsegment"]))


@register("encode_binary_customer_nulls", f"""
WITH d AS (SELECT *, COALESCE(c_mktsegment, 'nan') AS v FROM {D_SQL}),
     o AS (SELECT v, row_number() OVER (ORDER BY min(c_custkey)) AS ord FROM d GROUP BY v)
SELECT {CUST}, CAST((o.ord >> 2) & 1 AS INTEGER) AS c_mktsegment_0,
  CAST((o.ord >> 1) & 1 AS INTEGER) AS c_mktsegment_1, CAST(o.ord & 1 AS INTEGER) AS c_mktsegment_2
FROM d JOIN o ON d.v = o.v""")
def encode_binary_customer_nulls(spark, sf):
    return rounded(scale_encode.encode_binary(customer_nulls(spark, sf), ["c_mktsegment"],
                                              order_by=["c_custkey"]))


@register("drop_duplicates_document_texts", "SELECT DISTINCT text FROM documents")
def drop_duplicates_document_texts(spark, sf):
    return clean.drop_duplicates(table(spark, sf, "documents").select("text"))
