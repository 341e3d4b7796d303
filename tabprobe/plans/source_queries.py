"""Registered source / sink queries (R1-R7) and their SQL twins.

Delimited files are written from the fixture tables into the shared folder
the cluster names in ``spark.checkpoint.dir`` (never a machine-local folder),
then read back through the library's readers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabprobe.sources import delimited
from tabprobe.plans.fixtures import A_SQL, lineitem_nulls, rounded
from tabprobe.plans.registry import register
from tabprobe.session import cut_lineage, ensure_checkpoint_dir, table


def scratch_path(spark, name: str) -> str:
    """A new folder for a written table in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tabprobe-io/{name}-{uuid.uuid4().hex}"


def reread(df):
    """The frame with its rows written by a checkpoint, after which the file it was
    read from is no longer needed and is removed."""
    out = cut_lineage(df)
    spark = df.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if "/tabprobe-io/" in f:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(hadoop).delete(path, True)
    return out


def _part_with_tokens(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("p_partkey"), "p_name",
        F.when(F.col("p_brand") == "Brand#13", "?").otherwise(F.col("p_brand")).alias("p_brand"),
        F.when(F.col("p_type") == "PROMO", "NA").otherwise(F.col("p_type")).alias("p_type"),
        F.when(F.col("p_size") == 1, "n/a").otherwise(F.col("p_size").cast("string")).alias("p_size"),
        F.col("p_retailprice").cast("string").alias("p_retailprice"),
        F.lit("NONE").alias("junk"))


PART_TOKENS_SQL = """
SELECT p_partkey, p_name, CASE WHEN p_brand = 'Brand#13' THEN NULL ELSE p_brand END AS p_brand,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_type END AS p_type,
  CAST(CASE WHEN p_size = 1 THEN NULL ELSE p_size END AS BIGINT) AS p_size, p_retailprice FROM part"""


@register("read_delimited_part_semicolon", PART_TOKENS_SQL)
def read_delimited_part_semicolon(spark, sf):
    path = scratch_path(spark, "part-csv")
    delimited.write_table(_part_with_tokens(spark, sf), path, "csv", sep=";")
    return reread(delimited.read_delimited(spark, path, sep=";"))


@register("read_delimited_part_tab", PART_TOKENS_SQL)
def read_delimited_part_tab(spark, sf):
    path = scratch_path(spark, "part-tsv")
    delimited.write_table(_part_with_tokens(spark, sf), path, "csv", sep="\t")
    return reread(delimited.read_delimited(spark, path, sep="\t"))


@register("read_delimited_part_pipe", PART_TOKENS_SQL)
def read_delimited_part_pipe(spark, sf):
    path = scratch_path(spark, "part-psv")
    delimited.write_table(_part_with_tokens(spark, sf), path, "csv", sep="|")
    return reread(delimited.read_delimited(spark, path, sep="|"))


@register("read_delimited_part_line_breaks", """
SELECT p_partkey, replace(p_name, ' ', chr(10)) AS p_name, p_brand || ' "' || p_type || '"' AS p_brand, CAST(p_size AS BIGINT) AS p_size FROM part""")
def read_delimited_part_line_breaks(spark, sf):
    """Quoted fields with line breaks and quotes, by the default reader."""
    p = table(spark, sf, "part")
    path = scratch_path(spark, "part-breaks")
    delimited.write_table(p.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("\n")).alias("p_name"),
                                   F.concat("p_brand", F.lit(' "'), "p_type", F.lit('"')).alias("p_brand"), "p_size"), path, "csv")
    return reread(delimited.read_delimited(spark, path))


@register("normalize_missing_customer_text", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
  CASE WHEN c_nationkey = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def normalize_missing_customer_text(spark, sf):
    c = table(spark, sf, "customer")
    raw = c.select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name",
                   F.when(F.col("c_nationkey") == 0, "NONE").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
                   F.lit("null").alias("empty_col"), F.lit(None).cast("string").alias("all_missing"))
    return delimited.normalize_missing(raw)


def _headerless(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    path = scratch_path(spark, "part-noheader")
    p.write.mode("overwrite").option("header", False).csv(path)
    return path


@register("read_headerless_part", """
SELECT p_partkey AS "0", CAST(p_size AS BIGINT) AS "1", p_retailprice AS "2", p_brand AS "3" FROM part""")
def read_headerless_part(spark, sf):
    return reread(delimited.read_headerless(spark, _headerless(spark, sf)))


@register("rename_columns_part_coded", """
SELECT p_partkey AS "Płeć", CAST(p_size AS BIGINT) AS "Wiek", p_retailprice AS "Stosunek_zadłużenia",
  p_brand AS "Status_cywilny" FROM part""")
def rename_columns_part_coded(spark, sf):
    df = delimited.read_headerless(spark, _headerless(spark, sf), names=["A1", "A2", "A3", "A4"])
    return reread(delimited.rename_columns(df))


@register("write_table_parquet_roundtrip", f"""
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag FROM {A_SQL}""")
def write_table_parquet_roundtrip(spark, sf):
    path = scratch_path(spark, "lineitem-parquet")
    src = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount",
                                           "l_tax", "l_returnflag")
    delimited.write_table(src, path, "parquet")
    return reread(rounded(spark.read.parquet(path)))


@register("infer_types_orders_text", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
  o_orderpriority, o_orderstatus = 'F' AS is_final, CAST(o_orderkey AS VARCHAR) || 'x' AS tag FROM orders""")
def infer_types_orders_text(spark, sf):
    o = table(spark, sf, "orders")
    txt = o.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("o_custkey"),  # leading zeros stay numeric
        "o_orderstatus", F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority",
        F.when(F.col("o_orderstatus") == "F", "True").otherwise("False").alias("is_final"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit("x")).alias("tag"))
    return delimited.infer_types(txt)


@register("select_by_type_lineitem_numeric", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
FROM lineitem""")
def select_by_type_lineitem_numeric(spark, sf):
    return delimited.select_by_type(table(spark, sf, "lineitem"), "numeric")


@register("select_by_type_lineitem_text", "SELECT l_returnflag, l_linestatus FROM lineitem")
def select_by_type_lineitem_text(spark, sf):
    return delimited.select_by_type(table(spark, sf, "lineitem"), "categorical")
