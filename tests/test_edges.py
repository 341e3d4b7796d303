"""Edge cases of the operators: types kept, names distinct, nothing lost."""

import math

import pytest
from pyspark.sql import functions as F

from tabprobe.ml import classify, cluster, metrics, prepare
from tabprobe.operators import chartdata, clean, correlation, profile, scale_encode, stats
from tabprobe.sources import delimited


def test_late_invalid_byte_is_read_as_latin1(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_bytes(b"id,name\n" + b"".join(b"%d,plain\n" % i for i in range(12_000)) + b"99999,caf\xe9\n")
    assert delimited.detect_encoding(spark, str(path)) == "ISO-8859-1"
    out = delimited.read_delimited(spark, str(path))
    assert out.where("id = 99999").first()["name"] == "caf\u00e9" and out.count() == 12_001


def test_wide_integers_become_double(spark):
    df = spark.createDataFrame([("12345678901234567890", "1"), ("7", "2"), (None, "03")], "a string, b string")
    out = delimited.infer_types(df)
    assert dict(out.dtypes) == {"a": "double", "b": "bigint"}
    assert sorted(r["a"] for r in out.where("a IS NOT NULL").collect()) == [7.0, 12345678901234567890.0]


@pytest.mark.parametrize("method", ["mean", "median", "mode", "zero"])
def test_fills_keep_types(spark, method):
    df = spark.createDataFrame([(1, None, 9007199254740993, True, "x"), (2, "2024-01-02", 9007199254740993, None, None),
                                (3, "2024-01-02", 9007199254740992, False, "x"), (4, "2024-01-01", None, False, "y")],
                               "id int, d string, big long, b boolean, s string").withColumn("d", F.col("d").cast("timestamp")).withColumn(
        "arr", F.when(F.col("id") > 1, F.array(F.lit(1))))
    out = clean.fill_missing(df, method)
    kinds = dict(out.dtypes)
    assert kinds["d"] == "timestamp" and kinds["b"] == "boolean" and kinds["arr"] == "array<int>"
    row = {r["id"]: r for r in out.collect()}
    assert str(row[1]["d"]) == "2024-01-02 00:00:00" and row[2]["b"] is False and row[1]["arr"] == [1]
    assert row[2]["s"] == ("" if method == "zero" else "x")
    if method in ("mode", "zero"):
        assert kinds["big"] == "bigint" and row[4]["big"] == (0 if method == "zero" else 9007199254740993)


def test_all_missing_columns(spark):
    df = spark.createDataFrame([(1, None, None)], "id int, s string, d timestamp")
    assert clean.fill_mode(df).first().asDict() == {"id": 1, "s": "Unknown", "d": None}


def test_replace_by_missing_keeps_the_type(spark):
    df = spark.createDataFrame([(1.5,), (2.0,)], "x double")
    out = clean.replace_values(df, "x", "1.5", None)
    assert dict(out.dtypes) == {"x": "double"} and [r["x"] for r in out.orderBy("x").collect()] == [None, 2.0]


def test_tiny_spreads_do_not_raise(spark):
    df = spark.createDataFrame([(1e-170 * i,) for i in range(1, 8)], "x double")
    r = stats.numeric_summary(df).first()
    assert r["skewness"] == 0.0 and r["kurtosis"] == 0.0 and r["p50"] == pytest.approx(4e-170)


def test_onehot_names_ignore_case_and_cap_is_per_column(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "A", "y"), (3, "b", "x")], "S_B int, s string, t string")
    out = scale_encode.encode_onehot(df, ["s", "t"])
    assert out.columns == ["S_B", "s_A", "s_a_2", "s_b_2", "t_x", "t_y"]
    assert out.where("s_a_2").count() == 1
    with pytest.raises(ValueError):
        scale_encode.encode_onehot(df, ["s", "t"], max_categories=2)


def test_binary_codes_follow_first_appearance(spark):
    df = spark.range(400).select("id", ((F.col("id") * 7) % 13).cast("string").alias("s")).repartition(5)
    out = scale_encode.encode_binary(df, ["s"], order_by=["id"])
    code = {r["id"]: int("".join(str(r[f"s_{i}"]) for i in range(4)), 2) for r in out.collect()}
    seen = {}
    for i in range(400):
        seen.setdefault((i * 7) % 13, len(seen) + 1)
        assert code[i] == seen[(i * 7) % 13]


def test_maps_count_in_comparisons(spark):
    df = spark.createDataFrame([(1, {"a": 1}), (1, {"a": 2}), (1, {"a": 1}), (1, None)], "i int, m map<string,int>")
    assert profile.duplicate_count(df).first()[0] == 1 and profile.dataset_info(df).first()["missing_cells"] == 1
    out = clean.drop_duplicates(df)
    assert out.count() == 3 and dict(out.dtypes)["m"] == "map<string,int>"
    assert profile.duplicate_examples(df, limit=None).count() == 2


def test_dates_with_zones_names_and_padding(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05+01:00", "3 Jan 2024", " 2024-05-06 ", "9" * 500, "Jan was cold", None)] * 3,
                               "a string, b string, c string, d string, e string, f string")
    got = {r["column_name"]: r["detected_type"] for r in profile.detect_column_types(df).collect()}
    assert got == {"a": "datetime", "b": "datetime", "c": "datetime", "d": "numeric", "e": "categorical", "f": "numeric"}


def test_split_keeps_missing_labels(spark):
    df = spark.range(100).select("id", F.when(F.col("id") >= 20, F.col("id") % 2).alias("y"))
    out = prepare.stratified_split(df, "y", ["id"])
    assert out.count() == 100
    got = {r["y"]: (r["n"], r["t"]) for r in out.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    assert got == {None: (20, 6), 0: (40, 12), 1: (40, 12)}


def test_all_points_and_their_density(spark):
    df = spark.range(7000).select("id", (F.col("id") % 100).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    assert chartdata.scatter_points(df, "x", "y").count() == 7000 and chartdata.pair_grid_points(df).count() == 7000
    cells = chartdata.density_2d(df, "x", "y", 10, 7).collect()
    assert sum(r["n"] for r in cells) == 7000 and len(cells) == 70


def test_kendall_counts_do_not_overflow(spark):
    big = spark.createDataFrame([(4_000_000_000, 4_000_000_000)], "zeros long, ones_before long")
    d = lambda c: F.col(c).cast("decimal(19,0)")
    assert big.agg(F.sum((d("zeros") * d("ones_before")).cast("decimal(38,0)")).cast("double")).first()[0] == 1.6e19


def test_pearson_one_pass_equals_pairs(spark):
    df = spark.range(500).select(*[((F.col("id") * (2 * i + 3)) % (11 + i)).cast("double").alias(f"c{i}") for i in range(5)],
                                 F.when(F.col("id") % 3 > 0, F.col("id") * 1.0).alias("gap"), F.lit(1.0).alias("same"))
    pdf = df.toPandas()
    for r in correlation.corr_pearson(df).collect():
        want = pdf[r["col_a"]].corr(pdf[r["col_b"]]) if "same" not in (r["col_a"], r["col_b"]) else float("nan")
        assert (r["r"] is None) == math.isnan(want) and (r["r"] is None or r["r"] == pytest.approx(want, abs=1e-9))


def test_confusion_grid_and_names(spark):
    pred = spark.createDataFrame([(0.0, 0.0), (1.0, 2.0), (1.0, 1.0)], "label double, prediction double")
    assert metrics.confusion_matrix(pred).count() == 9
    rep = {r["row"]: r["support"] for r in metrics.classification_report(pred, target_names=["no", "yes", "maybe"]).collect()}
    assert rep["no"] == 1 and rep["yes"] == 2 and rep["maybe"] == 0


def _two_classes(spark, n=300):
    return spark.range(n).select("id", (F.col("id") % 2).cast("double").alias("y"),
                                 ((F.col("id") % 2) * 4 + F.sin(F.col("id").cast("double"))).alias("a"),
                                 F.cos(F.col("id").cast("double")).alias("b"))


@pytest.mark.parametrize("model,params", [
    ("logistic", {"C": 2.0, "max_iter": 50, "random_state": 1}),
    ("decision_tree", {"criterion": "entropy", "min_samples_leaf": 3, "max_depth": None}),
    ("random_forest", {"n_estimators": 5, "max_features": "sqrt", "criterion": "gini"}),
    ("svc", {"kernel": "linear"}), ("svc", {"kernel": "rbf", "gamma": "scale", "C": 3.0}), ("svc", {"gamma": 0.5}),
    ("knn", {"n_neighbors": 3}), ("knn", {"n_neighbors": 7, "weights": "distance"})])
def test_models_learn_under_the_same_calls(spark, model, params):
    df = _two_classes(spark)
    fitted = classify.train_classifier(df.where("id < 200"), ["a", "b"], "y", model, **params)
    pred = classify.predict(fitted, df.where("id >= 200"), ["a", "b"], "y")
    assert pred.count() == 100 and pred.where("label = prediction").count() >= 97


@pytest.mark.parametrize("model,params", [("knn", {"k": 3}), ("svc", {"kernel": "poly"}), ("svc", {"gamma": "x"}), ("logistic", {"n_neighbors": 1}),
                                          ("decision_tree", {"criterion": "mse"}), ("knn", {"weights": "w"}), ("boost", {})])
def test_unknown_parameters_raise(spark, model, params):
    with pytest.raises(ValueError):
        classify.train_classifier(_two_classes(spark, 20), ["a", "b"], "y", model, **params)


def test_knn_votes_by_distance(spark):
    ref = spark.createDataFrame([(1, [0.0], 0.0), (2, [1.0], 1.0), (3, [1.1], 1.0)], "id long, features array<double>, label double")
    q = spark.createDataFrame([(10, [0.1]), (11, [1.0])], "id long, features array<double>")
    uniform = {r["id"]: r["prediction"] for r in classify.knn_classify(q, ref, 3).collect()}
    near = {r["id"]: r["prediction"] for r in classify.knn_classify(q, ref, 3, weights="distance").collect()}
    assert uniform == {10: 1.0, 11: 1.0} and near == {10: 0.0, 11: 1.0}


def test_cross_validation_and_choice_of_k(spark):
    df = _two_classes(spark, 120).withColumn("y", F.col("y").cast("int"))
    acc = {r["fold"]: r["accuracy"] for r in classify.cross_validate(df, ["a", "b"], "y", ["id"], "decision_tree", folds=3).collect()}
    assert set(acc) == {0, 1, 2, -1, -2} and acc[-1] == pytest.approx(sum(acc[f] for f in range(3)) / 3)
    data = df.select("id", "a", "b")
    sq = {r["k"]: r["silhouette_sq"] for r in cluster.choose_k(data, ["a", "b"], ks=(2, 3), id_col="id").collect()}
    exact = {r["k"]: r["silhouette"] for r in cluster.choose_k(data, ["a", "b"], ks=(2, 3), id_col="id", measure="exact").collect()}
    assert max(sq, key=sq.get) == 2 and max(exact, key=exact.get) == 2


def test_density_integrates_to_one(spark):
    df = spark.range(3000).select((F.col("id") % 2).cast("string").alias("g"), (F.sin(F.col("id").cast("double")) * 3).alias("x"))
    rows = chartdata.density_by_group(df, "x", "g").collect()
    for g in ("0", "1"):
        pts = sorted((r["x"], r["density"]) for r in rows if r["g"] == g)
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))
        assert 0.7 < area <= 1.05


def test_rules_return_item_arrays(spark):
    from tabprobe.ml import rules
    b = rules.baskets(spark.createDataFrame([(i, x) for i in range(10) for x in ("a,b", "c")], "k int, item string"), "k", "item")
    sets, ar = rules.association_rules(b, 0.5, 0.5)
    assert {tuple(r["itemset"]) for r in sets.collect()} == {("a,b",), ("c",), ("a,b", "c")}
    assert {(tuple(r["antecedent"]), tuple(r["consequent"])) for r in ar.collect()} == {(("a,b",), ("c",)), (("c",), ("a,b",))}
