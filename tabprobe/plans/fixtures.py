"""Derived inputs shared by the registered queries and their SQL twins.

The driver tables hold no nulls, duplicates or NaN, so the missing-value and
duplicate operators run on inputs derived from them with the *same*
expression in Spark and in SQL (recipes A-H of FIXTURES.md).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.session import table


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column so Spark and SQL results compare exactly."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def lineitem_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """A: lineitem with zero discount / tax read as missing."""
    li = table(spark, sf, "lineitem")
    return li.withColumns({
        "l_discount": F.when(F.col("l_discount") == 0, None).otherwise(F.col("l_discount")),
        "l_tax": F.when(F.col("l_tax") == 0, None).otherwise(F.col("l_tax")),
    })


A_SQL = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS l_discount,
  CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END AS l_tax,
  l_returnflag, l_linestatus, l_shipdate FROM lineitem)"""


def documents_labels(spark: SparkSession, sf: str) -> DataFrame:
    """B: documents left-joined with labels (quality/toxic missing where unlabeled)."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left")


B_SQL = """(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def event_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """C: (event_type, user_id) -- many exact duplicate rows."""
    return table(spark, sf, "events").select("event_type", "user_id")


C_SQL = "(SELECT event_type, user_id FROM events)"


def customer_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """D: customer with the market segment missing for nation 0."""
    c = table(spark, sf, "customer")
    return c.withColumn("c_mktsegment",
                        F.when(F.col("c_nationkey") == 0, None).otherwise(F.col("c_mktsegment")))


D_SQL = """(SELECT c_custkey, c_name, c_nationkey, c_acctbal,
  CASE WHEN c_nationkey = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer)"""


def labeled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """E: labelled documents with numeric text features; target ``quality``."""
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels")
    return d.join(lab, "doc_id").select(
        "doc_id", "n_chars",
        F.length("text").cast("long").alias("text_len"),
        (F.length("text") - F.length(F.regexp_replace("text", "\n", ""))).cast("long").alias("n_lines"),
        (F.length("text") - F.length(F.regexp_replace("text", " ", ""))).cast("long").alias("n_spaces"),
        "toxic", "quality")


E_SQL = """(SELECT d.doc_id, d.n_chars,
  CAST(length(d.text) AS BIGINT) AS text_len,
  CAST(length(d.text) - length(replace(d.text, chr(10), '')) AS BIGINT) AS n_lines,
  CAST(length(d.text) - length(replace(d.text, ' ', '')) AS BIGINT) AS n_spaces,
  l.toxic, l.quality
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def price_lines(spark: SparkSession, sf: str) -> DataFrame:
    """H: strongly correlated price columns beside quantity."""
    li = table(spark, sf, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                     net.alias("net"), (net * (1 + F.col("l_tax"))).alias("gross"))


H_SQL = """(SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
  l_extendedprice * (1 - l_discount) AS net,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem)"""


def price_lines_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """H over A: correlated columns with missing values (pairwise-complete)."""
    li = lineitem_nulls(spark, sf)
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.select("l_quantity", "l_extendedprice", "l_discount", "l_tax",
                     net.alias("net"), (net * (1 + F.col("l_tax"))).alias("gross"))


HA_SQL = f"""(SELECT l_quantity, l_extendedprice, l_discount, l_tax,
  l_extendedprice * (1 - l_discount) AS net,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM {A_SQL})"""
