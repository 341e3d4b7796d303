"""Profiling operators.

Shared building blocks: one multi-column aggregate for per-column counts, a
``groupBy(all columns)`` for duplicates (map-side combined, so a hot
duplicate group collapses before the shuffle) and an unpivoted value count for
distinct/top-k questions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.functions.columns import (clean_numeric, is_numeric_type, is_text_type,
                                        missing as _missing, numeric_columns, qcol, text_columns)
from tabprobe.operators.stats import _empty, _per_column, text_value_counts, top_values

# The labels the type detector assigns, in order of precedence.
TYPE_LABELS = ("numeric", "datetime", "boolean", "categorical", "text")

# Lower-cased texts a two-valued boolean column may contain.
BOOLEAN_TOKENS = ("true", "false", "t", "f", "yes", "no", "y", "n", "1", "0", "+", "-")

# Text that parses as a number (also inf / nan, which the reference's parser accepts).
NUMERIC_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)\s*$"

# Date-time layouts tried on text columns.
DATETIME_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS",
                    "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS",
                    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss",
                    "dd.MM.yyyy", "dd.MM.yyyy HH:mm", "MM/dd/yyyy", "MM/dd/yyyy HH:mm", "d MMM yyyy", "d MMMM yyyy",
                    "MMM d, yyyy", "MMMM d, yyyy", "d-MMM-yyyy")

# Texts that may be dates: no longer than the longest layout, with a digit and date signs only.
DATETIME_SHAPE = r"^(?=.*\d)[0-9A-Za-z ,:/.+-]{6,40}$"


def comparable(df: DataFrame) -> DataFrame:
    """Map columns, which Spark cannot compare, as arrays of sorted entries."""
    maps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)]
    return df.withColumns({c: F.array_sort(F.map_entries(qcol(c))) for c in maps}) if maps else df


def row_hash(df: DataFrame, cols: Sequence[str]):
    """64-bit hash of the whole row; -0.0 and NaN are normalised so that rows
    the exact grouping treats as equal always share a hash."""
    parts = []
    for c in cols:
        x = qcol(c)
        if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            x = F.when(F.isnan(x), F.lit(float("nan"))).when(x == 0, F.lit(0.0)).otherwise(x.cast("double"))
        parts.append(x)
    return F.xxhash64(*parts)


def duplicate_candidates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hashed rows, hashes seen more than once).

    Only the 8-byte hash is shuffled (map-side combined) to find repeated
    hashes; a row whose hash is unique cannot have a duplicate, so exact
    grouping is needed for the candidate rows only."""
    cols = df.columns
    hashed = df.withColumn("_h", row_hash(df, cols))
    repeated = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_hn")).where(F.col("_hn") > 1).select("_h")
    return hashed, repeated


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Exact all-column groups (missing values equal) that have more than one
    row, with their size; computed among hash-collision candidates only."""
    df = comparable(df)
    cols = df.columns
    hashed, repeated = duplicate_candidates(df)
    cand = hashed.join(repeated, "_h", "left_semi")
    return (cand.groupBy("_h", *[qcol(c) for c in cols]).agg(F.count(F.lit(1)).alias("_n"))
                .where(F.col("_n") > 1).drop("_h"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row -> one row ``n_duplicates``."""
    return duplicate_groups(df).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def duplicate_examples(df: DataFrame, limit: int | None = 10,
                       order_by: Sequence[str] | None = None) -> DataFrame:
    """Every member of a duplicate group (``limit`` first ones when set).

    Repeated groups are found among hash candidates and matched back with a
    null-safe semi join restricted to the same hash."""
    kinds, names = df.schema, df.columns
    df = comparable(df)
    cols = df.columns
    hashed, repeated = duplicate_candidates(df)
    cand = hashed.join(repeated, "_h", "left_semi")
    groups = (cand.groupBy("_h", *[qcol(c) for c in cols]).agg(F.count(F.lit(1)).alias("_n"))
                  .where(F.col("_n") > 1))
    d = groups.select(F.col("_h").alias("_dh"), *[qcol(c).alias(f"_d{i}") for i, c in enumerate(cols)])
    cond = F.col("_h") == F.col("_dh")
    for i, c in enumerate(cols):
        cond = cond & qcol(c).eqNullSafe(F.col(f"_d{i}"))
    if limit is not None and not order_by:  # first rows in table (scan) order
        cand = cand.withColumn("_pos", F.monotonically_increasing_id())
    out = cand.join(d, cond, "left_semi").drop("_h")
    if limit is not None:
        keys = [qcol(c) for c in order_by] if order_by else [F.col("_pos")]
        out = out.orderBy(*keys).limit(limit)
    back = [F.map_from_entries(qcol(c)).alias(c) if isinstance(kinds[c].dataType, T.MapType) else qcol(c) for c in names]
    return out.select(*back)


def dataset_info(df: DataFrame) -> DataFrame:
    """One row -- rows, columns, numeric / text column counts, missing
    cells and duplicated rows. Counts and missing cells are one global
    aggregate (no shuffle); duplicates come from the hash-first grouping."""
    cols = df.columns
    miss = F.lit(0).cast("long")
    for c in cols:
        miss = miss + _missing(df, c).cast("long")
    totals = df.agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                    F.coalesce(F.sum(miss), F.lit(0)).cast("long").alias("missing_cells"),
                    F.lit(0).cast("long").alias("duplicate_rows"))
    dups = duplicate_count(df).select(F.lit(0).cast("long").alias("n_rows"),
                                      F.lit(0).cast("long").alias("missing_cells"),
                                      F.col("n_duplicates").alias("duplicate_rows"))
    both = totals.unionByName(dups)
    return both.agg(
        F.sum("n_rows").cast("long").alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.lit(len(numeric_columns(df))).cast("long").alias("n_numeric"),
        F.lit(len(text_columns(df))).cast("long").alias("n_text"),
        F.sum("missing_cells").cast("long").alias("missing_cells"),
        F.sum("duplicate_rows").cast("long").alias("duplicate_rows"))


def column_kinds(df: DataFrame) -> DataFrame:
    """P1 (schema part): (ordinal, column_name, data_type, kind) from the schema."""
    rows = [(i, f.name, f.dataType.simpleString(),
             "numeric" if is_numeric_type(f.dataType) else
             "categorical" if is_text_type(f.dataType) else "other")
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, column_name string, data_type string, kind string")


def missing_summary(df: DataFrame) -> DataFrame:
    """P5: (column_name, n_missing, pct_missing) for columns with missing cells."""
    cols = list(df.columns)
    per = _per_column(df, cols, lambda c: [F.count_if(_missing(df, c)).alias("n_missing"),
                                           F.count(F.lit(1)).alias("_rows")])
    return (per.where(F.col("n_missing") > 0)
               .orderBy("_ord")
               .select("column_name", F.col("n_missing").cast("long").alias("n_missing"),
                       (F.col("n_missing") * 100.0 / F.col("_rows")).alias("pct_missing")))


def rows_with_missing(df: DataFrame, limit: int | None = 100,
                      order_by: Sequence[str] | None = None) -> DataFrame:
    """Rows with at least one missing cell (first ``limit`` when set)."""
    any_missing = F.lit(False)
    for c in df.columns:
        any_missing = any_missing | _missing(df, c)
    if limit is None:
        return df.where(any_missing)
    if order_by:
        return df.where(any_missing).orderBy(*[qcol(c) for c in order_by]).limit(limit)
    # first rows in table (scan) order: a position, then a bounded TakeOrdered
    pos = df.withColumn("_pos", F.monotonically_increasing_id())
    return pos.where(any_missing).orderBy("_pos").limit(limit).drop("_pos")


def value_counts_topk(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The ``k`` most frequent non-null values (count desc, value asc)."""
    c = qcol(column)
    return (df.where(c.isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), c.asc()).limit(k))


def numeric_ranges(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """P10: min, max, mean, sample std per numeric column (one aggregate)."""
    cols = numeric_columns(df, columns)
    if not cols:
        return _empty(df, "column_name string, min double, max double, mean double, std double")

    def make(c):
        x = clean_numeric(df, c)
        return [F.min(x).alias("min"), F.max(x).alias("max"),
                F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")]
    return _per_column(df, cols, make).orderBy("_ord").drop("_ord")


def categorical_info(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct count, most frequent value (smallest on ties) and missing
    count per text column."""
    cols = text_columns(df, columns)
    if not cols:
        return _empty(df, "column_name string, n_distinct long, most_frequent string, n_missing long")
    counts = text_value_counts(df, cols)
    distinct = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    modes = top_values(counts, 1).select("column_name", F.col("value").alias("most_frequent"))
    missing = _per_column(df, cols, lambda c: [F.count_if(qcol(c).isNull()).alias("n_missing")])
    return (missing.join(F.broadcast(distinct), "column_name", "left")
                   .join(F.broadcast(modes), "column_name", "left")
                   .orderBy("_ord")
                   .select("column_name",
                           F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"),
                           "most_frequent", F.col("n_missing").cast("long").alias("n_missing")))


# ------------------------------------------------------------------ type detection

def layout_shape(fmt: str) -> str:
    """Pattern that every text of a date-time layout matches (and some others do): numbers where it has
    numbers, letters where it has names, its own signs between them."""
    out = ""
    for m in re.finditer(r"'([^']*)'|(([A-Za-z])\3*)|(.)", fmt):
        quoted, run, letter, sign = m.groups()
        if run:
            out += r"\D+" if letter == "M" and len(run) > 2 else r".+" if letter == "X" else r"[+-]?\d+"
        else:
            out += re.escape(quoted if quoted is not None else sign)
    return out


def _is_datetime(v):
    """Does the text (trimmed) parse in one of the layouts? Only texts that look like one -- short, a digit, and
    the signs dates are made of, in the order of some layout -- are parsed, and only by the layouts they look like:
    a parse that fails costs far more than a match."""
    t = F.trim(v)
    shapes = [layout_shape(fmt) for fmt in DATETIME_FORMATS]
    parsed = F.lit(False)
    for fmt, shape in zip(DATETIME_FORMATS, shapes):
        parsed = parsed | F.when(t.rlike(f"(?is)^{shape}$"), F.try_to_timestamp(t, F.lit(fmt)).isNotNull()).otherwise(False)
    looks = t.rlike(DATETIME_SHAPE) & t.rlike(f"(?is)^(?:{'|'.join(dict.fromkeys(shapes))})$")
    return F.when(looks, parsed).otherwise(False)


def _text_tests(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per text column: the facts the detector needs.

    What holds for every value is one row-level aggregate without a shuffle (the
    token set has at most 12 members); distinct values are counted over
    256-bit digests, so whole texts never leave their task."""
    longest = max(len(t) for t in BOOLEAN_TOKENS)

    def facts(c):
        v = qcol(c)
        tok = (F.length(v) <= longest) & F.lower(v).isin(*BOOLEAN_TOKENS)
        return [F.count(v).alias("n_valid"), F.bool_and(v.rlike("(?i)" + NUMERIC_PATTERN)).alias("all_numeric"),
                F.bool_and(_is_datetime(v)).alias("all_datetime"), F.bool_and(tok).alias("all_bool_tokens"),
                F.size(F.collect_set(F.when(tok, F.lower(v)))).alias("n_lower")]
    tests = _per_column(df, cols, facts).drop("_ord")
    long = df.select(*[F.unhex(F.sha2(qcol(c), 256)).alias(c) for c in cols]).unpivot(
        [], [qcol(c) for c in cols], "column_name", "digest").where(F.col("digest").isNotNull())
    distinct = long.distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    # a column without values has no facts
    return tests.where("n_valid > 0").join(F.broadcast(distinct), "column_name")  # one row per column


def detect_column_types(df: DataFrame) -> DataFrame:
    """Label each column numeric / datetime / boolean / categorical / text
    (first rule that holds wins). Typed columns are labelled from the schema;
    text columns from one pass over their distinct values."""
    spark = df.sparkSession
    fields = df.schema.fields
    examine = [f.name for f in fields
               if not is_numeric_type(f.dataType)
               and not isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    order = spark.createDataFrame([(i, f.name) for i, f in enumerate(fields)],
                                  "_ord int, column_name string")
    fixed = spark.createDataFrame(
        [(f.name, "numeric" if is_numeric_type(f.dataType) else "datetime")
         for f in fields if f.name not in examine] or [("", "")],
        "column_name string, _fixed string").where(F.col("column_name") != "")
    if examine:
        tests = _text_tests(df.select(*[qcol(c).cast("string").alias(c) for c in examine]), examine)
    else:
        tests = spark.createDataFrame([], "column_name string, n_distinct long, n_valid long, "
                                          "all_numeric boolean, all_datetime boolean, "
                                          "all_bool_tokens boolean, n_lower long")
    n_distinct = F.coalesce(F.col("n_distinct"), F.lit(0))
    label = (F.when(F.col("_fixed").isNotNull(), F.col("_fixed"))
             .when(F.col("n_valid").isNull() | F.col("all_numeric"), F.lit("numeric"))
             .when(F.col("all_datetime"), F.lit("datetime"))
             .when((F.col("n_lower") <= 2) & F.col("all_bool_tokens"), F.lit("boolean"))
             .when((n_distinct / F.col("n_valid") < 0.05) | (n_distinct < 10), F.lit("categorical"))
             .otherwise(F.lit("text")))
    return (order.join(fixed, "column_name", "left").join(tests, "column_name", "left")
                 .orderBy("_ord").select("column_name", label.alias("detected_type")))


# ------------------------------------------------------------------ advice and validation

def _column_facts(df: DataFrame) -> DataFrame:
    """(column_name, _ord, n_missing, n_rows, n_distinct, range) per column.

    Distinct values are shuffled for text columns only (their count is
    reported); for other column types the advice needs only "at most one
    distinct value", which is min = max in the same aggregate (n_distinct is
    then 0 or 1 exactly, and 2 stands for "more than one")."""
    cols = df.columns
    num = set(numeric_columns(df))
    text = [c for c in cols if is_text_type(df.schema[c].dataType)]
    orderable = [c for c in cols if c not in text and not isinstance(
        df.schema[c].dataType, (T.ArrayType, T.StructType, T.BinaryType))]

    def facts(c):
        x = clean_numeric(df, c) if c in num else qcol(c)
        out = [F.count_if(_missing(df, c)).alias("n_missing"), F.count(F.lit(1)).alias("n_rows"),
               ((F.max(x) - F.min(x)) if c in num else F.lit(None).cast("double")).alias("value_range")]
        if c in orderable:
            few = (F.when(F.count(x) == 0, 0).when(F.min(x) == F.max(x), 1).otherwise(2))
            out.append(few.cast("long").alias("_few"))
        else:
            out.append(F.lit(None).cast("long").alias("_few"))
        return out

    per = _per_column(df, cols, facts)
    rest = [c for c in cols if c not in orderable]
    if rest:
        long = df.select(*[qcol(c).cast("string").alias(c) for c in rest]).unpivot(
            [], [qcol(c) for c in rest], "column_name", "value")
        distinct = (long.where(F.col("value").isNotNull()).select("column_name", "value").distinct()
                        .groupBy("column_name").agg(F.count(F.lit(1)).alias("_nd")))
        per = per.join(F.broadcast(distinct), "column_name", "left")
    else:
        per = per.withColumn("_nd", F.lit(None).cast("long"))
    return per.withColumn("n_distinct", F.coalesce("_few", "_nd", F.lit(0)).cast("long")).drop("_few", "_nd")


SUGGESTION_DDL = "rule string, column_name string, value double"


def suggest_preprocessing(df: DataFrame) -> DataFrame:
    """(rule, column_name, value) advice rows.

    rules: high_missing (> 50 % missing), some_missing, duplicates, constant
    (<= 1 distinct value), scale (largest numeric range > 100 x smallest, more
    than one numeric column), high_cardinality (text column > 10 distinct).
    """
    facts = _column_facts(df)
    text = set(text_columns(df))
    num = numeric_columns(df)
    pct = F.col("n_missing") / F.col("n_rows")
    per_col = facts.select(
        "_ord", "column_name",
        F.array(
            F.when((F.col("n_missing") > 0) & (F.col("n_missing") > F.col("n_rows") * 0.5),
                   F.struct(F.lit("high_missing").alias("rule"), pct.alias("value"))),
            F.when((F.col("n_missing") > 0) & (F.col("n_missing") <= F.col("n_rows") * 0.5),
                   F.struct(F.lit("some_missing").alias("rule"), pct.alias("value"))),
            F.when(F.col("n_distinct") <= 1,
                   F.struct(F.lit("constant").alias("rule"),
                            F.col("n_distinct").cast("double").alias("value"))),
            F.when(F.col("column_name").isin(*text) & (F.col("n_distinct") > 10) if text else F.lit(False),
                   F.struct(F.lit("high_cardinality").alias("rule"),
                            F.col("n_distinct").cast("double").alias("value"))),
        ).alias("_s"))
    rows = (per_col.select("_ord", "column_name", F.explode("_s").alias("s"))
                   .where(F.col("s").isNotNull())
                   .select("_ord", F.col("s.rule").alias("rule"), "column_name",
                           F.col("s.value").alias("value")))
    dups = duplicate_count(df).where(F.col("n_duplicates") > 0).select(
        F.lit(10_000).alias("_ord"), F.lit("duplicates").alias("rule"),
        F.lit(None).cast("string").alias("column_name"),
        F.col("n_duplicates").cast("double").alias("value"))
    out = rows.unionByName(dups)
    if len(num) > 1:
        ranges = facts.where(F.col("column_name").isin(*num) & F.col("value_range").isNotNull())
        scale = ranges.agg(F.max("value_range").alias("mx"), F.min("value_range").alias("mn")).where(
            F.col("mx") > F.col("mn") * 100).select(
            F.lit(10_001).alias("_ord"), F.lit("scale").alias("rule"),
            F.lit(None).cast("string").alias("column_name"),
            F.try_divide(F.col("mx"), F.col("mn")).alias("value"))
        out = out.unionByName(scale)
    return out.orderBy("_ord", "rule").drop("_ord")


VALIDATION_DDL = "level string, rule string, column_name string, value double, detail string"


def validate_structure(df: DataFrame, raw_header: Sequence[str] | None = None) -> DataFrame:
    """(level, rule, column_name, value, detail) findings.

    empty -> error; fewer than 2 rows / columns -> warning; duplicate column
    names (checked on ``raw_header`` when the reader renamed them) -> error;
    missing cells > 80 % error, > 50 % warning, > 0 info; one info row per
    detected column type.
    """
    spark = df.sparkSession
    names = list(raw_header) if raw_header is not None else list(df.columns)
    dup_names = sorted({n for n in names if names.count(n) > 1})
    n_cols = len(df.columns)
    info = dataset_info(df)
    cells = F.col("n_rows") * F.lit(n_cols)
    pct = F.when(cells > 0, F.col("missing_cells") * 100.0 / cells).otherwise(F.lit(0.0))
    s = lambda level, rule, value: F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"),
                                            value.cast("double").alias("value"))
    checks = info.select(F.explode(F.array(
        F.when(F.col("n_rows") == 0, s("error", "empty", F.col("n_rows"))),
        F.when((F.col("n_rows") > 0) & (F.col("n_rows") < 2), s("warning", "few_rows", F.col("n_rows"))),
        F.when(F.lit(n_cols < 2), s("warning", "few_columns", F.lit(n_cols))),
        F.when(pct > 80, s("error", "missing_cells_pct", pct))
         .when(pct > 50, s("warning", "missing_cells_pct", pct))
         .when(pct > 0, s("info", "missing_cells_pct", pct)),
    )).alias("c")).where(F.col("c").isNotNull()).select(
        F.col("c.level").alias("level"), F.col("c.rule").alias("rule"),
        F.lit(None).cast("string").alias("column_name"), F.col("c.value").alias("value"),
        F.lit(None).cast("string").alias("detail"))
    dups = spark.createDataFrame([("error", "duplicate_column_name", n, None, None) for n in dup_names]
                                 or [("", "", None, None, None)], VALIDATION_DDL).where(F.col("level") != "")
    types = detect_column_types(df).select(
        F.lit("info").alias("level"), F.lit("detected_type").alias("rule"), "column_name",
        F.lit(None).cast("double").alias("value"), F.col("detected_type").alias("detail"))
    return checks.unionByName(dups).unionByName(types)
