"""Matching a user-typed literal against a typed column (trap 3).

The reference compares the *text form* of each cell with the literal. Casting
cells to string in Spark renders numbers differently (``1.0E8``), so the
literal is interpreted on the driver instead: if it is the canonical text of a
value of the column's type, a typed equality is emitted (it pushes down to the
Parquet scan); otherwise no cell can match. ``nan`` matches missing cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.functions.columns import qcol

MISSING_TEXT = "nan"


def parse_literal(dt: T.DataType, text: str):
    """Typed value whose canonical text form is ``text``, or ``None`` if no
    value of type ``dt`` prints as ``text``."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        try:
            v = int(text)
        except ValueError:
            return None
        return v if str(v) == text else None
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        try:
            v = float(text)
        except ValueError:
            return None
        if math.isnan(v) or repr(v) != text:
            return None
        return v
    if isinstance(dt, T.DecimalType):
        from decimal import Decimal, InvalidOperation
        try:
            v = Decimal(text)
        except InvalidOperation:
            return None
        return v if str(v) == text else None
    if isinstance(dt, T.BooleanType):
        return {"True": True, "False": False}.get(text)
    return text


def matches(df: DataFrame, column: str, text: str) -> Column:
    """Does the cell's text form equal ``text``? A plain typed comparison, so it
    reaches the Parquet scan; a missing cell compares as NULL (not kept by a
    filter) unless ``text`` is ``nan``."""
    c = qcol(column)
    dt = df.schema[column].dataType
    if text == MISSING_TEXT:
        missing = c.isNull()
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            missing = missing | F.isnan(c)
        if isinstance(dt, T.StringType):
            missing = missing | (c == F.lit(text))
        return missing
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("string") == F.lit(text)
    v = parse_literal(dt, text)
    if v is None:
        return F.lit(False)
    return c == F.lit(v)


def not_matches(df: DataFrame, column: str, text: str) -> Column:
    """Complement of ``matches`` over all rows (missing cells do not match a
    value literal), written so that Parquet can evaluate it: ``c <> v OR c IS NULL``."""
    c = qcol(column)
    dt = df.schema[column].dataType
    if text == MISSING_TEXT:
        return ~matches(df, column, text)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return (c.cast("string") != F.lit(text)) | c.isNull()
    v = parse_literal(dt, text)
    if v is None:
        return F.lit(True)
    return (c != F.lit(v)) | c.isNull()
