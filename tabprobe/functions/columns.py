"""Column classification and small column-expression helpers.

The reference distinguishes only "numeric" and "categorical (text)" columns.
Booleans are never numeric here (one contract for every operator).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
            T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, _NUMERIC)


def is_text_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def numeric_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Numeric columns of ``df`` in table order, optionally restricted."""
    wanted = None if columns is None else set(columns)
    return [f.name for f in df.schema.fields
            if is_numeric_type(f.dataType) and (wanted is None or f.name in wanted)]


def text_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    wanted = None if columns is None else set(columns)
    return [f.name for f in df.schema.fields
            if is_text_type(f.dataType) and (wanted is None or f.name in wanted)]


def qcol(name: str) -> Column:
    """Column reference that tolerates dots and spaces in names."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean_numeric(df: DataFrame, name: str) -> Column:
    """Numeric value as double with NaN read as missing (NaN is not NULL in Spark)."""
    c = qcol(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c.cast("double"))
    return c.cast("double")


def missing(df: DataFrame, name: str) -> Column:
    """True where a cell is missing (NULL, or NaN in a floating column)."""
    c = qcol(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def hash_order_key(id_cols, seed: int) -> Column:
    """md5 of ``<id>-<seed>`` -- the same text order in Spark and SQL engines."""
    idt = F.concat_ws("-", *[qcol(c).cast("string") for c in id_cols])
    return F.md5(F.concat(idt, F.lit(f"-{seed}")).cast("binary"))
