"""Unit tests on degenerate in-memory columns."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprobe.functions.literals import parse_literal
from tabprobe.operators import chartdata, clean, correlation, positions, profile, scale_encode, stats
from tabprobe.operators.ordering import with_row_id, with_running_sum


def _rows(df):
    return [r.asDict() for r in df.collect()]


def test_skew_kurtosis_corrected_match_pandas(spark):
    vals = [1.0, 2.0, 2.5, 4.0, 7.0, 7.5, 11.0, 20.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = _rows(stats.numeric_summary(df))[0]
    s = pd.Series(vals)
    assert r["skewness"] == pytest.approx(s.skew(), rel=1e-9)
    assert r["kurtosis"] == pytest.approx(s.kurtosis(), rel=1e-9)
    assert r["p25"] == pytest.approx(s.quantile(0.25))
    assert r["p50"] == pytest.approx(s.median())
    assert r["p75"] == pytest.approx(s.quantile(0.75))
    assert r["std"] == pytest.approx(s.std())


def test_constant_column_is_zero_not_spurious(spark):
    # 0.1 repeated over 8 partitions: stddev is not exactly 0 there (trap 1)
    df = spark.range(100_000).repartition(8).select(F.lit(0.1).alias("x"))
    r = _rows(stats.numeric_summary(df))[0]
    assert r["skewness"] == 0.0 and r["kurtosis"] == 0.0
    assert r["p25"] == pytest.approx(0.1) and r["p75"] == pytest.approx(0.1)


def test_one_row_and_all_null(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    rows = {r["column_name"]: r for r in _rows(stats.numeric_summary(df))}
    assert rows["a"]["n"] == 1 and rows["a"]["std"] is None and rows["a"]["skewness"] is None
    assert rows["b"]["n"] == 0 and rows["b"]["mean"] is None and rows["b"]["p50"] is None


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    r = _rows(stats.numeric_summary(df))[0]
    assert r["n"] == 2 and r["mean"] == 2.0
    m = _rows(profile.missing_summary(df))[0]
    assert m["n_missing"] == 2


def test_pearson_constant_is_null_not_error(spark):
    df = spark.range(1000).repartition(8).select(F.lit(0.1).alias("c"), F.col("id").cast("double").alias("x"))
    cells = {(r["col_a"], r["col_b"]): r["r"] for r in _rows(correlation.corr_pearson(df))}
    assert cells[("c", "x")] is None and cells[("c", "c")] is None and cells[("x", "x")] == 1.0


def test_pearson_pairwise_complete(spark):
    pdf = pd.DataFrame({"a": [1, 2, 3, 4, 5, None, 7.0], "b": [2, 1, 4, 3, None, 6, 8.0]})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double")
    cells = {(r["col_a"], r["col_b"]): r["r"] for r in _rows(correlation.corr_pearson(df))}
    assert cells[("a", "b")] == pytest.approx(pdf["a"].corr(pdf["b"]), rel=1e-9)


def _tau_b(x, y):
    """Brute-force Kendall tau-b over all pairs (numpy, in row chunks)."""
    import numpy as np
    m = ~(np.isnan(x) | np.isnan(y))
    x, y = x[m], y[m]
    s = nx = ny = 0
    for i in range(0, len(x), 500):
        dx = np.sign(x[i:i + 500, None] - x[None, :])
        dy = np.sign(y[i:i + 500, None] - y[None, :])
        s += (dx * dy).sum()
        nx += (dx != 0).sum()
        ny += (dy != 0).sum()
    return (s / 2) / math.sqrt((nx / 2) * (ny / 2))


def test_spearman_and_kendall_match_pandas_with_ties_and_nulls(spark):
    import random
    random.seed(3)
    xs = [random.choice([None, 1, 2, 2, 3, 5, 8, 8, 8, 13]) for _ in range(200)]
    ys = [random.choice([None, 0.5, 1.5, 1.5, 2.0, 3.0, 9.0]) for _ in range(200)]
    zs = [float(i % 17) for i in range(200)]
    pdf = pd.DataFrame({"x": xs, "y": ys}, dtype=float)
    df = spark.createDataFrame([(None if a is None else float(a), b, z) for a, b, z in zip(xs, ys, zs)],
                               "x double, y double, z double")
    sp = {(r["col_a"], r["col_b"]): r["r"] for r in _rows(correlation.correlation_matrix(df, "spearman"))}
    both = pdf.dropna()
    assert sp[("x", "y")] == pytest.approx(both["x"].rank().corr(both["y"].rank()), rel=1e-9)
    xz = pd.DataFrame({"x": xs, "z": zs}, dtype=float).dropna()
    assert sp[("x", "z")] == pytest.approx(xz["x"].rank().corr(xz["z"].rank()), rel=1e-9)
    assert sp[("z", "x")] == sp[("x", "z")]
    kd = {(r["col_a"], r["col_b"]): r["r"] for r in _rows(correlation.correlation_matrix(df, "kendall"))}
    assert kd[("x", "y")] == pytest.approx(_tau_b(pdf["x"].to_numpy(), pdf["y"].to_numpy()), rel=1e-9)


@pytest.mark.parametrize("rows_per_bucket", [10**9, 50])
def test_kendall_brute_force_on_lineitem_with_nulls(spark, monkeypatch, rows_per_bucket):
    """Whole-table Kendall against brute force, few and many buckets."""
    from tabprobe.operators import ordering
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", rows_per_bucket)
    from tabprobe.plans.fixtures import price_lines_nulls
    df = price_lines_nulls(spark, "/root/testdata/sf0.001").select("l_quantity", "l_discount", "l_tax")
    pdf = df.toPandas()
    got = {(r["col_a"], r["col_b"]): r["r"] for r in _rows(correlation.corr_kendall(df))}
    for (a, b), v in got.items():
        if a != b:
            want = _tau_b(pdf[a].to_numpy(dtype=float), pdf[b].to_numpy(dtype=float))
            assert v == pytest.approx(want, rel=1e-9)


def test_value_match_is_text_match(spark):
    from pyspark.sql import types as T
    assert parse_literal(T.DoubleType(), "5") is None
    assert parse_literal(T.DoubleType(), "5.0") == 5.0
    assert parse_literal(T.DoubleType(), "1e+16") == 1e16
    assert parse_literal(T.LongType(), "007") is None
    assert parse_literal(T.BooleanType(), "True") is True
    df = spark.createDataFrame([(5.0, "a"), (5.5, None), (None, "nan")], "x double, s string")
    assert clean.remove_rows_by_value(df, "x", "5").count() == 3
    assert clean.remove_rows_by_value(df, "x", "5.0").count() == 2
    assert clean.keep_rows_by_value(df, "s", "nan").count() == 2
    assert clean.keep_rows_by_value(df, "x", "nan").count() == 1
    assert clean.keep_rows_by_value(df, "s", "zzz").count() == 3  # no match -> unchanged


def test_mode_ties_take_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    out = _rows(clean.fill_mode(df))
    assert sorted(r["s"] for r in out) == ["a", "a", "a", "b", "b"]
    info = _rows(profile.categorical_info(df))[0]
    assert info["most_frequent"] == "a" and info["n_missing"] == 1 and info["n_distinct"] == 2


def test_fill_all_missing_defaults(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, s string")
    out = _rows(clean.fill_mode(df))
    assert out[0]["x"] == 0 and out[0]["s"] == "Unknown"


def test_scalers_constant_and_incomplete_rows(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0), (2.0, 5.0)], "a double, b double")
    mm = _rows(scale_encode.scale_minmax(df, ["a", "b"]))
    assert [r["a"] for r in mm] == [0.0, 1.0, None, 0.5]
    assert [r["b"] for r in mm] == [0.0, 0.0, 5.0, 0.0]  # incomplete row keeps raw value
    st = _rows(scale_encode.scale_standard(df, ["a"]))
    assert st[0]["a"] == pytest.approx((1.0 - 2.0) / math.sqrt(2.0 / 3.0))


def test_range_ratio_zero_min(spark):
    df = spark.createDataFrame([(1.0, 7.0), (1.0, 9.0)], "a double, b double")
    rules = {r["rule"] for r in _rows(profile.suggest_preprocessing(df))}
    assert "scale" in rules and "constant" in rules


def test_histogram_edges(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "x double")
    h = _rows(chartdata.histogram(df, "x", 5))
    assert [r["n"] for r in h] == [3, 0, 0, 0, 0]
    df = spark.createDataFrame([(0.0,), (10.0,), (5.0,)], "x double")
    h = _rows(chartdata.histogram(df, "x", 2))
    assert [r["n"] for r in h] == [1, 2]  # the maximum falls in the last bin


def test_index_spec_parsing():
    assert positions.parse_index_spec("1,3-5,7") == [(1, 1), (3, 5), (7, 7)]
    assert positions.parse_index_spec("  ") == []
    assert positions.parse_index_spec("4-6,5-9,10") == [(4, 10)]
    with pytest.raises(ValueError):
        positions.parse_index_spec("a-b")


@pytest.mark.parametrize("buckets", [1, 8, 64])
def test_row_id_contiguous_and_hot_key(spark, buckets):
    # one key holds most rows: ids stay contiguous and unique
    df = spark.range(20_000).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id")).alias("k"), "id")
    ided = with_row_id(df, ["k"], num_partitions=buckets)
    ids = sorted(r[0] for r in ided.select("row_id").collect())
    assert ids == list(range(20_000))
    first_hot = ided.where("k = 0").agg(F.max("row_id")).first()[0]
    assert first_hot == 13_999


@pytest.mark.parametrize("buckets", [1, 8, 64])
def test_row_ids_put_missing_and_nan_keys_in_order(spark, buckets):
    """Missing keys come first, NaN last, at any number of buckets."""
    df = spark.range(4000).select(
        F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 100 == 1, F.lit(float("nan"))).otherwise(F.col("id") * 1.0).alias("k"), "id")
    ids = {r["id"]: r["row_id"] for r in with_row_id(df, ["k", "id"], num_partitions=buckets).collect()}
    order = sorted(range(4000), key=lambda i: (0, 0, i) if i % 4 == 0 else (2, 0, i) if i % 100 == 1 else (1, i, i))
    assert [ids[i] for i in order] == list(range(4000))
    text = spark.createDataFrame([(None, 1), ("b", 2), ("a", 3), (None, 4), ("", 5)], "s string, n int")
    got = {r["n"]: r["row_id"] for r in with_row_id(text, ["s", "n"], num_partitions=buckets).collect()}
    assert got == {1: 0, 4: 1, 5: 2, 3: 3, 2: 4}


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_running_sum_groups_span_buckets(spark, buckets):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("g"), F.col("id").alias("v"),
                                  F.lit(2).alias("w"))
    out = with_running_sum(df, "g", ["v"], "w", num_buckets=buckets).fillna({"g": "0"})
    pdf = out.toPandas().sort_values(["g", "v"])
    exp = pdf.groupby("g")["w"].cumsum() - pdf["w"]
    assert (pdf["before"].to_numpy() == exp.to_numpy()).all()


def test_duplicates_with_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x"), (2, "x"), (3, "y")], "a int, b string")
    assert profile.duplicate_count(df).first()[0] == 3
    assert clean.drop_duplicates(df).count() == 3
    assert profile.duplicate_examples(df, limit=None).count() == 5


def test_detect_types(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-0%d" % (i % 9 + 1), "yes" if i % 2 else "no", "c%d" % (i % 3), "t%d" % i, None)
         for i in range(40)],
        "n string, d string, b string, c string, t string, e string")
    got = {r["column_name"]: r["detected_type"] for r in _rows(profile.detect_column_types(df))}
    assert got == {"n": "numeric", "d": "datetime", "b": "boolean", "c": "categorical",
                   "t": "text", "e": "numeric"}


def test_encoders(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "id int, s string")
    oh = scale_encode.encode_onehot(df, ["s"])
    assert oh.columns == ["id", "s_a", "s_b", "s_nan"]
    be = scale_encode.encode_binary(df, ["s"], order_by=["id"])
    assert be.columns == ["id", "s_0", "s_1"]
    bits = {r["id"]: (r["s_0"], r["s_1"]) for r in be.collect()}
    assert bits == {1: (0, 1), 2: (1, 0), 3: (1, 1), 4: (0, 1)}  # b=1, nan=2, a=3


def test_pie_other_bucket(spark):
    df = spark.createDataFrame([(c,) for c in "aaaabbbccdefghijklm"], "s string")
    rows = _rows(chartdata.pie_shares(df, "s", max_categories=4))
    assert [r["value"] for r in rows[:3]] == ["a", "b", "c"]
    assert rows[3]["is_other"] and rows[3]["n"] == 10
    assert sum(r["share_pct"] for r in rows) == pytest.approx(100.0)


def test_keep_rows_by_index_renumbers(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    out = positions.keep_rows_by_index(df, "2-3,8,50", order_by=["k"])
    assert sorted((r["k"], r["row_id"]) for r in out.collect()) == [(2, 0), (3, 1), (8, 2)]
    out = positions.remove_rows_by_index(df, "0,5-6", order_by=["k"])
    assert sorted(r["row_id"] for r in out.collect()) == list(range(7))


@pytest.mark.parametrize("sketch,margin", [(1000, 0.002), (10, 0.0001), (1000, 0.5)])
def test_quantiles_agree_with_pandas(spark, monkeypatch, sketch, margin):
    """Narrow intervals, intervals that miss their rank, whole columns."""
    from tabprobe.operators import quantiles
    monkeypatch.setattr(quantiles, "SKETCH", sketch)
    monkeypatch.setattr(quantiles, "MARGIN", margin)
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("value", "user_id")
    pdf = ev.toPandas()
    got = {(r["column_name"], r["prob"]): r["value"]
           for r in quantiles.exact_quantiles(ev, ["value", "user_id"], (0.1, 0.25, 0.5, 0.9)).collect()}
    for c in ("value", "user_id"):
        for p in (0.1, 0.25, 0.5, 0.9):
            assert got[(c, p)] == pytest.approx(pdf[c].quantile(p), rel=1e-12)
    prof = quantiles.ColumnProfile(ev, ["value"], moments=True)
    _, m2, m3, _ = prof.central_moments(0)
    assert m2 / (prof.n[0] - 1) == pytest.approx(pdf["value"].var(), rel=1e-9)


def test_quantiles_with_infinity(spark):
    from tabprobe.operators import quantiles
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, float("inf"), 5, float("-inf")]], "x double")
    got = {r["prob"]: r["value"] for r in quantiles.exact_quantiles(df, ["x"], (0.0, 0.5, 1.0)).collect()}
    assert got[0.0] == float("-inf") and got[0.5] == 2.5 and got[1.0] == float("inf")


def test_duplicates_hash_normalisation(spark):
    df = spark.createDataFrame([(0.0, None), (-0.0, None), (float("nan"), "a"), (float("nan"), "a"),
                                (1.0, "b")], "x double, s string")
    assert profile.duplicate_count(df).first()[0] == 2
    assert clean.drop_duplicates(df).count() == 3
    info = profile.dataset_info(df).first()
    assert info["n_rows"] == 5 and info["duplicate_rows"] == 2 and info["missing_cells"] == 4


def test_numeric_summary_approx_close_to_exact(spark):
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    exact = {r["column_name"]: r for r in stats.numeric_summary(ev, ["value"]).collect()}
    approx = {r["column_name"]: r for r in stats.numeric_summary(ev, ["value"], approx=True).collect()}
    pdf = ev.select("value").toPandas()["value"]
    assert exact["value"]["p50"] == pytest.approx(pdf.median())
    assert approx["value"]["p50"] == pytest.approx(pdf.median(), rel=1e-2)
    assert approx["value"]["mean"] == exact["value"]["mean"]


def test_first_rows_follow_table_order(spark):
    from tabprobe.session import table
    pairs = table(spark, "/root/testdata/sf0.01", "events").select("event_type", "user_id")
    got = profile.duplicate_examples(pairs, limit=10).collect()
    pdf = pairs.toPandas()
    want = pdf[pdf.duplicated(keep=False)].head(10)
    assert [tuple(r) for r in got] == [tuple(x) for x in want.itertuples(index=False)]
    li = table(spark, "/root/testdata/sf0.01", "lineitem").select("l_orderkey", "l_discount")
    li = li.withColumn("l_discount", F.when(F.col("l_discount") == 0, None).otherwise(F.col("l_discount")))
    rows = profile.rows_with_missing(li, limit=5).collect()
    lpdf = li.toPandas()
    expect = lpdf[lpdf.isna().any(axis=1)].head(5)
    assert [r["l_orderkey"] for r in rows] == list(expect["l_orderkey"])


def test_suggestions_constant_and_cardinality(spark):
    rows = [(1.0, "k", None, f"v{i}", True) for i in range(12)]
    df = spark.createDataFrame(rows, "a double, t string, e double, h string, b boolean")
    got = {(r["rule"], r["column_name"]): r["value"] for r in profile.suggest_preprocessing(df).collect()}
    assert got[("constant", "a")] == 1 and got[("constant", "t")] == 1 and got[("constant", "b")] == 1
    assert got[("constant", "e")] == 0 and got[("high_missing", "e")] == 1.0
    assert got[("high_cardinality", "h")] == 12
    assert ("constant", "h") not in got


def test_pearson_constant_only_on_complete_rows(spark):
    # b varies overall but is constant on the rows where a is present too
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, None), (None, 7.0)], "a double, b double")
    cells = {(r["col_a"], r["col_b"]): r["r"] for r in _rows(correlation.corr_pearson(df))}
    assert cells[("a", "b")] is None and cells[("a", "a")] == 1.0 and cells[("b", "b")] == 1.0


def test_per_column_chunks(spark, monkeypatch):
    monkeypatch.setattr(stats, "COLUMNS_PER_AGGREGATE", 2)
    df = spark.createDataFrame([(1.0, None, 3.0, "x", None), (2.0, 5.0, None, None, None)],
                               "a double, b double, c double, s string, t string")
    got = {r["column_name"]: r["n_missing"] for r in profile.missing_summary(df).collect()}
    assert got == {"b": 1, "c": 1, "s": 1, "t": 2}
    assert [r["column_name"] for r in profile.numeric_ranges(df).collect()] == ["a", "b", "c"]


def test_paging_and_edits(spark):
    df = spark.range(25).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 10)
    assert sorted(r["k"] for r in positions.page_rows(df, 0, 10, order_by=["k"]).collect()) == list(range(10))
    assert sorted(r["k"] for r in positions.page_rows(df, 99, 10, order_by=["k"]).collect()) == [20, 21, 22, 23, 24]
    assert positions.page_count(0, 10) == 1 and positions.page_count(25, 10) == 3
    base = positions.remove_rows_by_index(df, "", order_by=["k"])
    edits = spark.createDataFrame([(3, None), (7, 700)], "row_id long, v long")
    out = {r["k"]: r["v"] for r in positions.apply_edits(base, edits).collect()}
    assert out[3] is None and out[7] == 700 and out[8] == 80
    gone = positions.remove_rows_by_index(df, "0-24", order_by=["k"])
    assert gone.count() == 0
