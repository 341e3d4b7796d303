"""Delimited-text sources and sinks.

Reading is: all-string CSV scan (so that several missing-value tokens and
type inference are under our control) -> token normalisation (R2) -> type
inference (R6). Type inference changes the schema, so it is one eager
aggregate over the data, returning one row of counts.
"""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.functions.columns import is_text_type, numeric_columns, qcol, text_columns
from tabprobe.functions.aggregates import agg_row
from tabprobe.sources import quoted

# Cell texts that mean "missing" after loading (the 11 tokens
# the reference replaces explicitly).
MISSING_TOKENS = ("?", "NA", "na", "N/A", "n/a", "", " ", "null", "NULL", "None", "NONE")

# Tokens read as missing while parsing -- the explicit list above
# without "NONE", plus the default missing markers of the reference's CSV parser.
READ_MISSING_TOKENS = ("?", "NA", "na", "N/A", "n/a", "", " ", "null", "NULL",
                       "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                       "1.#IND", "1.#QNAN", "<NA>", "NaN", "None", "nan")

# The separators offered for delimited files.
SEPARATORS = (",", ";", "|", "\t")

# Readable names for the coded columns of the bundled credit data set.
CREDIT_COLUMN_NAMES = {
    "A1": "Płeć",
    "A2": "Wiek",
    "A3": "Stosunek_zadłużenia",
    "A4": "Status_cywilny",
    "A5": "Typ_klienta_banku",
    "A6": "Poziom_wykształcenia",
    "A7": "Branża_zatrudnienia",
    "A8": "Staż_zatrudnienia",
    "A9": "Ma_rachunek_RO",
    "A10": "Ma_rachunek_OS",
    "A11": "Liczba_aktywnych_kredytów",
    "A12": "Posiada_inne_zobowiązania",
    "A13": "Cel_kredytu",
    "A14": "Długość_historii_kredytowej",
    "A15": "Roczny_dochód",
    "A16": "Decyzja_przyznania_kredytu",
}

INT_PATTERN = r"^\s*[+-]?\d+\s*$"
FLOAT_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)\s*$"
BOOL_VALUES = ("True", "False", "TRUE", "FALSE", "true", "false")


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless any line holds byte sequences that are not valid UTF-8; then
    ISO-8859-1, which accepts any byte. All lines are tested; the scan stops
    at the first invalid one."""
    lines = spark.read.text(path)
    bad = lines.where(~F.is_valid_utf8("value")).limit(1).count()
    return "ISO-8859-1" if bad else "UTF-8"


def read_strings(spark: SparkSession, path: str, sep: str = ",", header: bool = True,
                 encoding: str | None = None, names: Sequence[str] | None = None,
                 multiline: bool = False) -> DataFrame:
    """All-string scan of a delimited file; read-time missing tokens -> NULL.

    Quoted fields may hold line breaks: if some line holds an odd number of quotes (an
    early-stopping probe tells), records are put together by ``quoted.read_quoted`` in
    parallel over the splits. ``multiline`` has Spark's own reader do it instead, which
    makes every file one task."""
    if sep not in SEPARATORS:
        raise ValueError(f"unsupported separator {sep!r}")
    enc = encoding or detect_encoding(spark, path)
    reader = (spark.read.option("header", header).option("sep", sep).option("encoding", enc)
              .option("inferSchema", False).option("mode", "PERMISSIVE")
              .option("nullValue", "\u0000").option("emptyValue", "")
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
              .option("escape", '"').option("multiLine", multiline))
    if not multiline and quoted.has_quoted_breaks(spark, path):
        df = quoted.read_quoted(spark, path, sep, enc, header)
    else:
        df = reader.csv(path)
    if names is not None:
        if len(names) != len(df.columns):
            raise ValueError("names do not match the column count")
        df = df.toDF(*names)
    tokens = list(READ_MISSING_TOKENS)
    return df.select(*[F.when(qcol(c).isin(*tokens), None).otherwise(qcol(c)).alias(c)
                       for c in df.columns])


def _non_null_counts(df: DataFrame) -> dict[str, int]:
    if not df.columns:
        return {}
    row = agg_row(df, [F.count(qcol(c)).alias(f"_n{i}") for i, c in enumerate(df.columns)])
    return {c: int(row[f"_n{i}"]) for i, c in enumerate(df.columns)}


def normalize_missing(df: DataFrame, tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """R2: drop all-missing rows, map the missing tokens of text columns to
    NULL, and drop the columns that are entirely missing.

    Rows that become empty only through the token mapping stay, as in the
    reference. Which columns survive depends on the data: one aggregate.
    """
    full = F.lit(False)
    for c in df.columns:
        full = full | qcol(c).isNotNull()
    rows = df.where(full)
    txt = set(text_columns(rows))
    mapped = rows.select(*[
        (F.when(qcol(c).isin(*tokens), None).otherwise(qcol(c)) if c in txt else qcol(c)).alias(c)
        for c in rows.columns])
    counts = _non_null_counts(mapped)
    keep = [c for c in mapped.columns if counts[c] > 0]
    return mapped.select(*[qcol(c) for c in keep])


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cast text columns whose every non-missing cell is an integer ->
    bigint, a number -> double, True/False -> boolean. Leading zeros are
    numeric; integers of which some are beyond 64 bits make a double column.
    One aggregate of per-column pattern counts decides."""
    cols = [c for c in (columns or df.columns) if is_text_type(df.schema[c].dataType)]
    if not cols:
        return df
    aggs = []
    for i, c in enumerate(cols):
        x = qcol(c)
        aggs += [F.count(x).alias(f"n{i}"),
                 F.count_if(x.rlike(INT_PATTERN) & F.trim(x).try_cast("long").isNotNull()).alias(f"i{i}"),
                 F.count_if(x.rlike("(?i)" + FLOAT_PATTERN)).alias(f"f{i}"),
                 F.count_if(x.isin(*BOOL_VALUES)).alias(f"b{i}")]
    r = agg_row(df, aggs)
    casts = {}
    for i, c in enumerate(cols):
        n = r[f"n{i}"]
        if n == 0:
            continue
        x = F.trim(qcol(c))
        if r[f"i{i}"] == n:
            casts[c] = x.cast("long")
        elif r[f"f{i}"] == n:
            casts[c] = x.cast("double")
        elif r[f"b{i}"] == n:
            casts[c] = F.lower(x) == F.lit("true")
    return df.withColumns(casts) if casts else df


def read_delimited(spark: SparkSession, path: str, sep: str = ",",
                   encoding: str | None = None, header: bool = True,
                   multiline: bool = False) -> DataFrame:
    """Delimited file with a header -> normalised, typed table."""
    return infer_types(normalize_missing(read_strings(spark, path, sep, header, encoding,
                                                      multiline=multiline)))


def read_headerless(spark: SparkSession, path: str, names: Sequence[str] | None = None,
                    sep: str = ",", encoding: str | None = None) -> DataFrame:
    """Header-less file; columns are named ``names`` or by position
    (``"0"``, ``"1"``, ...)."""
    raw = read_strings(spark, path, sep, header=False, encoding=encoding)
    cols = list(names) if names is not None else [str(i) for i in range(len(raw.columns))]
    return infer_types(normalize_missing(raw.toDF(*cols)))


def rename_columns(df: DataFrame, mapping: Mapping[str, str] = CREDIT_COLUMN_NAMES) -> DataFrame:
    """Rename the columns present in ``mapping``."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def write_table(df: DataFrame, path: str, fmt: str = "csv", sep: str = ",",
                mode: str = "overwrite") -> None:
    """Persist with a header and without a position column. CSV is the
    reference's format; Parquet is the better one for a cluster."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("sep", sep).option("escape", '"').csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def select_by_type(df: DataFrame, kind: str = "numeric") -> DataFrame:
    """Numeric-only or text-only projection (booleans are neither)."""
    if kind == "numeric":
        cols = numeric_columns(df)
    elif kind in ("categorical", "text"):
        cols = text_columns(df)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return df.select(*[qcol(c) for c in cols])


def raw_header(spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None) -> list[str]:
    """The names of the header record as written (the reader renames duplicate names)."""
    enc = encoding or detect_encoding(spark, path)
    first = quoted.text_lines(spark, path, enc).where(F.trim("line") != "").select("line").limit(1).collect()
    return next(csv.reader([first[0][0].removesuffix("\r")], delimiter=sep), []) if first else []
