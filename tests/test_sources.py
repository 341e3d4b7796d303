"""Delimited sources: encodings, missing-value tokens, type inference, validation."""

import os
import tempfile

from pyspark.sql import functions as F

from tabprobe.operators import profile
from tabprobe.sources import delimited


def _write(text: str, encoding: str, name: str = "data.csv") -> str:
    d = tempfile.mkdtemp(prefix="tabprobe-src-")
    path = os.path.join(d, name)
    with open(path, "w", encoding=encoding) as f:
        f.write(text)
    return path


def test_latin1_detected_and_decoded(spark):
    path = _write("name,age,city\nJózef,31,Łódź\nAnna,?,Kraków\n", "utf-8")
    assert delimited.detect_encoding(spark, path) == "UTF-8"
    path = _write("name,age,city\nJosé,31,São Paulo\nAnna,?,Köln\n", "latin-1")
    assert delimited.detect_encoding(spark, path) == "ISO-8859-1"
    df = delimited.read_delimited(spark, path)
    rows = sorted((r["name"], r["age"], r["city"]) for r in df.collect())
    assert rows == [("Anna", None, "Köln"), ("José", 31, "São Paulo")]
    assert dict(df.dtypes)["age"] == "bigint"


def test_tokens_rows_and_columns(spark):
    text = "a;b;c;d\n1;x;NA;NONE\n;;;\n2.5;?;n/a;NONE\n3;y;;NONE\n"
    df = delimited.read_delimited(spark, _write(text, "utf-8"), sep=";")
    # the all-empty row is dropped; d holds only NONE -> dropped after the token step;
    # c is all missing from the start -> dropped
    assert df.columns == ["a", "b"]
    assert dict(df.dtypes)["a"] == "double"
    assert sorted((r["a"], r["b"]) for r in df.collect()) == [(1.0, "x"), (2.5, None), (3.0, "y")]


def test_leading_zeros_and_booleans(spark):
    text = "code,flag,label\n00202,True,a\n007,False,b\n"
    df = delimited.read_delimited(spark, _write(text, "utf-8"))
    assert dict(df.dtypes) == {"code": "bigint", "flag": "boolean", "label": "string"}
    assert sorted(r["code"] for r in df.collect()) == [7, 202]


def test_duplicate_header_names_reported(spark):
    path = _write("a,a,b\n1,2,3\n4,5,6\n", "utf-8")
    df = delimited.read_delimited(spark, path)
    header = delimited.raw_header(spark, path)
    findings = profile.validate_structure(df, raw_header=header).collect()
    dups = [r for r in findings if r["rule"] == "duplicate_column_name"]
    assert [(r["level"], r["column_name"]) for r in dups] == [("error", "a")]


def test_headerless_positional_names_and_rename(spark):
    path = _write("b,30.5,1\na,22.0,0\n", "utf-8")
    df = delimited.read_headerless(spark, path)
    assert df.columns == ["0", "1", "2"]
    named = delimited.rename_columns(delimited.read_headerless(spark, path, names=["A1", "A2", "A16"]))
    assert named.columns == ["Płeć", "Wiek", "Decyzja_przyznania_kredytu"]


def test_write_table_round_trip(spark):
    df = spark.range(5).select(F.col("id"), (F.col("id") * 1.5).alias("x"))
    out = os.path.join(tempfile.mkdtemp(prefix="tabprobe-out-"), "t")
    delimited.write_table(df, out, "csv")
    back = delimited.read_delimited(spark, out)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_quoted_line_breaks(spark):
    path = _write('id,note\n1,"first line\nsecond line"\n2,plain\n', "utf-8")
    df = delimited.read_delimited(spark, path, multiline=True)
    rows = sorted((r["id"], r["note"]) for r in df.collect())
    assert rows == [(1, "first line\nsecond line"), (2, "plain")]
