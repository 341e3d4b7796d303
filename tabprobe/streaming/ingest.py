"""Ingest normalisation for streaming sources.

The reference works on one uploaded file; it has no streams. What carries
over to Structured Streaming are the row-wise parts of ingest: reading
delimited files as they arrive with an explicit all-string schema and mapping
the missing-value tokens to NULL. Operators that need the whole table (column
drops, type inference, statistics) run on the batch table the stream writes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.functions.columns import qcol
from tabprobe.sources.delimited import MISSING_TOKENS, READ_MISSING_TOKENS


def read_delimited_stream(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",",
                          header: bool = True, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming scan of delimited files under ``path`` (all-string columns)."""
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    r = spark.readStream.schema(schema).option("header", header).option("sep", sep)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return normalize_tokens(r.csv(path))


def normalize_tokens(df: DataFrame, tokens: Sequence[str] = tuple(READ_MISSING_TOKENS) + tuple(MISSING_TOKENS)) -> DataFrame:
    """Map missing-value tokens of string columns to NULL (stateless, so it is
    valid on streaming and batch DataFrames alike)."""
    toks = sorted(set(tokens))
    return df.select(*[
        (F.when(qcol(f.name).isin(*toks), None).otherwise(qcol(f.name))
         if isinstance(f.dataType, T.StringType) else qcol(f.name)).alias(f.name)
        for f in df.schema.fields])
