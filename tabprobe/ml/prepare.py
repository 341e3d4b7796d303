"""Model input preparation (M1-M3, M13): label indexing, features, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.functions.columns import clean_numeric, hash_order_key, is_numeric_type, numeric_columns, qcol
from tabprobe.operators.clean import drop_rows_missing
from tabprobe.operators.ordering import with_row_id, with_running_sum
from tabprobe.operators.scale_encode import scale_minmax, scale_standard
from tabprobe.functions.aggregates import agg_row
from tabprobe.session import cut_lineage

SPLIT_SEED = 42


def class_table(df: DataFrame, target: str) -> DataFrame:
    """(class_index, class_name): the sorted distinct non-missing target values."""
    names = cut_lineage(df.where(qcol(target).isNotNull()).select(qcol(target).alias("class_name")).distinct())
    return with_row_id(names, ["class_name"], name="class_index").select(
        F.col("class_index").cast("int").alias("class_index"), "class_name")


def index_labels(df: DataFrame, target: str, name: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """M1: text target -> 0..k-1 in sorted order (rows with a missing target
    are dropped), by a join with the class table; a numeric target is kept.
    Returns (table, class table; None for a numeric target)."""
    out = name or target
    base = df.where(qcol(target).isNotNull())
    if is_numeric_type(df.schema[target].dataType):
        return base.withColumn(out, qcol(target)), None
    classes = class_table(base, target)
    keyed = classes.select(F.col("class_name").alias("_class_name"), F.col("class_index").alias("_class_index"))
    joined = base.join(keyed, qcol(target) == F.col("_class_name"))
    return joined.withColumn(out, F.col("_class_index")).drop("_class_name", "_class_index"), classes


def prepare_features(df: DataFrame, target: str, fit_on: str = "all",
                     train: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """M2: drop rows with a missing cell in *any* column, keep the numeric
    feature columns, standardise them with the population std.

    ``fit_on='all'`` fits on every row (the reference's behaviour, which leaks
    test rows into the scaling); pass ``fit_on='train'`` with ``train`` to fit
    on the training split only. Returns (table with target + scaled features,
    feature names)."""
    complete = drop_rows_missing(df)
    feats = [c for c in numeric_columns(complete) if c != target]
    if not feats:
        raise ValueError("no numeric feature columns")
    fit_src = complete if fit_on == "all" else drop_rows_missing(train)
    p = agg_row(fit_src, [x for i, c in enumerate(feats) for x in (
        F.avg(clean_numeric(fit_src, c)).alias(f"m{i}"), F.stddev_pop(clean_numeric(fit_src, c)).alias(f"s{i}"),
        (F.min(qcol(c)) == F.max(qcol(c))).alias(f"k{i}"))])
    cols = [qcol(target)]
    for i, c in enumerate(feats):
        m, s, k = p[f"m{i}"], p[f"s{i}"], p[f"k{i}"]
        x = clean_numeric(complete, c)
        cols.append(((x - F.lit(m)) / F.lit(s) if (s and not k) else F.lit(0.0)).cast("double").alias(c))
    return complete.select(*cols), feats


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Vector column for ``pyspark.ml`` estimators."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def split_key(id_cols: Sequence[str], seed: int = SPLIT_SEED):
    return hash_order_key(id_cols, seed)


CUT_DIGITS = 3  # hexadecimal digits of the hash that one refinement looks at
CUT_ROWS = 1024  # rows of a class that are ranked one by one
BROADCAST_CLASSES = 100_000  # with more classes (one short row each) their cuts are joined by a shuffle


def _per_class(rows: DataFrame, classes: int) -> DataFrame:
    """One row a class, broadcast if their number is small."""
    return F.broadcast(rows) if classes <= BROADCAST_CLASSES else rows


def hash_cuts(keyed: DataFrame, wanted: DataFrame, classes: int) -> DataFrame:
    """(_c, _cut, _exact): the hash of the ``_k``-th row in hash order of each class, and whether
    rows of that class up to it number ``_k`` exactly (rows with one hash may straddle the cut).

    ``keyed``: _cls, _h (hexadecimal text); ``wanted``: _c, _k (>= 1). Rows of a class are counted by the
    next digits of their hash, the prefix that holds the k-th is refined until it holds few rows, and these
    are ranked. Only counts are shuffled, at most 16 ** CUT_DIGITS a class and pass."""
    left = wanted.withColumn("_p", F.lit(""))
    depth = 0
    while True:
        depth += CUT_DIGITS
        inside = keyed.join(_per_class(left, classes), F.col("_cls").eqNullSafe(F.col("_c")) & F.startswith("_h", F.col("_p")))
        counts = inside.groupBy("_c", "_k", F.substring("_h", 1, depth).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy("_c").orderBy("_p"))
        left = cut_lineage(counts.withColumn("_u", upto).where((F.col("_u") >= F.col("_k")) & (F.col("_u") - F.col("_n") < F.col("_k")))
                                 .select("_c", (F.col("_k") - F.col("_u") + F.col("_n")).alias("_k"), "_p", "_n"))
        most = left.agg(F.max("_n")).first()[0] or 0
        left = left.drop("_n")
        if most <= CUT_ROWS or depth >= 32:
            break
    inside = keyed.join(_per_class(left, classes), F.col("_cls").eqNullSafe(F.col("_c")) & F.startswith("_h", F.col("_p")))
    hashes = inside.groupBy("_c", "_k", "_h").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_c").orderBy("_h"))
    return (hashes.withColumn("_u", upto).where((F.col("_u") >= F.col("_k")) & (F.col("_u") - F.col("_n") < F.col("_k")))
                  .select("_c", F.col("_h").alias("_cut"), (F.col("_u") == F.col("_k")).alias("_exact")))


def stratified_split(df: DataFrame, label: str, id_cols: Sequence[str],
                     test_size: float = 0.3, seed: int = SPLIT_SEED) -> DataFrame:
    """M3: add ``is_test``: in each class, rows ordered by md5(id-seed); the
    first round(test_size * n_class) are test rows. Rows with a missing label
    are kept and split as a class of their own.

    The cut hash of each class is selected from counts (``hash_cuts``), then a comparison
    splits the rows where they are: no row is shuffled. Only if rows with one and the same
    hash straddle a cut (repeated ids) are rows numbered by a distributed running count."""
    keyed = df.withColumn("_h", split_key(id_cols, seed)).withColumn("_cls", qcol(label).cast("string"))
    sizes = df.groupBy(qcol(label).cast("string").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    wanted = cut_lineage(sizes.select("_c", F.round(F.col("_n") * F.lit(test_size), 0).cast("long").alias("_k")))
    classes = wanted.count()
    cuts = cut_lineage(hash_cuts(keyed.select("_cls", "_h"), wanted.where("_k > 0"), classes))
    if not cuts.where("NOT _exact").isEmpty():
        ranked = with_running_sum(keyed.withColumn("_one", F.lit(1)), "_cls", ["_h"], "_one", name="_pos")
        return (ranked.join(wanted, F.col("_cls").eqNullSafe(F.col("_c"))).withColumn("is_test", F.col("_pos") < F.col("_k"))
                      .drop("_h", "_one", "_cls", "_c", "_pos", "_k"))
    marked = keyed.join(_per_class(cuts, classes), F.col("_cls").eqNullSafe(F.col("_c")), "left")
    return marked.withColumn("is_test", F.coalesce(F.col("_h") <= F.col("_cut"), F.lit(False))).drop("_h", "_cls", "_c", "_cut", "_exact")


def fold_assignment(df: DataFrame, label: str, id_cols: Sequence[str], folds: int = 5,
                    seed: int = SPLIT_SEED) -> DataFrame:
    """Stratified fold number 0..folds-1: position in class (hash order) mod folds."""
    keyed = (df.withColumn("_h", split_key(id_cols, seed)).withColumn("_one", F.lit(1))
               .withColumn("_cls", qcol(label).cast("string")))
    ranked = with_running_sum(keyed, "_cls", ["_h"], "_one", name="_pos")
    return ranked.withColumn("fold", (F.col("_pos") % folds).cast("int")).drop("_h", "_one", "_cls", "_pos")


def prepare_clustering(df: DataFrame, columns: Sequence[str] | None = None,
                       scaler: str = "standard") -> tuple[DataFrame, list[str]]:
    """Numeric columns, complete rows only, scaled (``standard`` or
    ``minmax``; the argument is honoured)."""
    cols = numeric_columns(df, columns)
    if not cols:
        raise ValueError("no numeric columns")
    sub = drop_rows_missing(df.select(*[qcol(c) for c in cols]))
    if scaler == "standard":
        return scale_standard(sub, cols), cols
    if scaler == "minmax":
        return scale_minmax(sub, cols), cols
    raise ValueError(f"unknown scaler {scaler!r}")
