"""K-means models trained and measured in shared passes."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabprobe.ml import cluster, lloyd


def _points(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)],
                                 "id long, features array<double>").repartition(3).cache()


def _blobs(n=600, seed=1, shift=0.0):
    rng = np.random.default_rng(seed)
    return rng.uniform(-9, 9, (5, 3))[np.arange(n) % 5] + rng.normal(0, 1.5, (n, 3)) + shift


def _lloyd(x, centers, steps):
    for _ in range(steps):
        near = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[near == c].mean(0) if (near == c).any() else centers[c] for c in range(len(centers))])
        if ((new - centers) ** 2).sum(1).max() <= lloyd.TOLERANCE ** 2:
            break
        centers = new
    return ((x[:, None] - centers[None]) ** 2).sum(2).min(1).sum()


def test_equal_inertia_from_equal_starts_in_shared_passes(spark):
    x = _blobs(shift=1e4)
    df = _points(spark, x)
    ks = (2, 3, 5)
    origin = x.mean(0)
    models = {k: lloyd.Model(origin, x[:k] - origin) for k in ks}  # poor starts: many passes
    lloyd.fit_many(df, models)
    for k in ks:
        assert models[k].inertia == pytest.approx(_lloyd(x - origin, x[:k] - origin, 300), rel=1e-9)
        assert models[k].rows.sum() == len(x) and models[k].passes > 1
    assert len({m.passes for m in models.values()}) > 1  # a model at rest takes no part in later passes


def test_passes_end_at_max_iter_with_sums_of_the_returned_centres(spark):
    x = _blobs(seed=2)
    m = lloyd.Model(np.zeros(3), x[:4].copy())
    lloyd.fit_many(_points(spark, x), {4: m}, max_iter=2)
    assert m.passes == 2
    assert m.inertia == pytest.approx(((x[:, None] - m.centers[None]) ** 2).sum(2).min(1).sum(), rel=1e-9)


def test_silhouettes_equal_the_evaluator(spark):
    x = _blobs(seed=3)
    df = _points(spark, x)
    models = lloyd.fit_many(df, lloyd.starts(df, (2, 4), 42, 300))
    got = lloyd.silhouettes_sq(df, models)
    marked = lloyd.assigned(df, models)
    for i, k in enumerate((2, 4)):
        pred = marked.select(array_to_vector("features").alias("features"), F.col("clusters")[i].cast("double").alias("prediction"))
        assert got[k] == pytest.approx(ClusteringEvaluator().evaluate(pred), rel=1e-6)


def test_inertia_no_worse_than_one_fit_each(spark):
    x = _blobs(seed=4)
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double")
    got = {r["k"]: r for r in cluster.choose_k(df, ["a", "b", "c"], ks=(2, 5)).collect()}
    one = KMeans(k=5, seed=42, maxIter=300).fit(cluster.assemble(df, ["a", "b", "c"])).summary.trainingCost
    assert got[5]["inertia"] <= 1.05 * one
    assert got[5]["inertia"] < got[2]["inertia"] and got[5]["silhouette_sq"] > 0.5


def test_missing_features_few_rows_and_empty_table(spark):
    schema = "a double, b double"
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (5.0, 5.0), (None, 2.0), (float("nan"), 0.0)], schema)
    got = {r["k"]: r for r in cluster.choose_k(df, ["a", "b"], ks=(1, 2, 4)).collect()}
    assert got[1]["silhouette_sq"] is None and got[1]["inertia"] == pytest.approx(64 / 3)
    assert got[2]["inertia"] == pytest.approx(0) and got[4]["inertia"] == pytest.approx(0)
    assert got[2]["silhouette_sq"] == pytest.approx(2 / 3)  # the lone row counts 0
    assert cluster.choose_k(df.where("a > 100"), ["a", "b"], ks=(2,)).count() == 0


def test_exact_silhouettes_of_all_models_at_once(spark):
    x = _blobs(seed=5, n=120)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
    got = {r["k"]: r["silhouette"] for r in cluster.choose_k(df, ["a", "b", "c"], ks=(2, 3), id_col="id", measure="exact").collect()}
    pts = df.select("id", F.array("a", "b", "c").alias("features"))
    models = lloyd.fit_many(pts, lloyd.starts(pts, (2, 3), cluster.KMEANS_SEED, 300))
    marked = lloyd.assigned(pts, models)
    for i, k in enumerate((2, 3)):
        one = cluster.silhouette(marked.select("id", "features", F.col("clusters")[i].alias("cluster"))).first()[0]
        assert got[k] == pytest.approx(one, rel=1e-9)
