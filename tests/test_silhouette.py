"""The silhouette interval against the exact silhouette."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprobe.ml import cluster


def _points(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    c = np.minimum(rng.integers(0, 6, n), 3)  # one cluster holds half of the rows
    x = rng.normal(0, 4, (4, 3))[c] + rng.normal(size=(n, 3))
    rows = [(i, [float(t) for t in v], int(k)) for i, (v, k) in enumerate(zip(x, c))]
    return spark.createDataFrame(rows + [(n, [0.0, 9.0, 0.0], 77)], "id long, features array<double>, cluster int").repartition(3).cache()


def test_whole_sample_is_exact(spark):
    pts = _points(spark, 200)
    got = cluster.silhouette_interval(pts, 10_000).first()
    exact = cluster.silhouette(pts).first()[0]
    assert got["silhouette"] == pytest.approx(exact, abs=1e-9)
    assert got["low"] == got["high"] == got["silhouette"] and got["sampled"] == got["n"] == 201


def test_interval_holds_the_exact_value(spark):
    pts = _points(spark)
    exact = cluster.silhouette(pts).first()[0]
    # an interval that may miss in one of 10^5 draws (README gives the measured rates of narrower ones)
    got = [cluster.silhouette_interval(pts, 120, 0.99999, seed).first() for seed in range(4)]
    assert all(g["low"] <= exact <= g["high"] and g["sampled"] < 140 for g in got)
    assert max(g["high"] - g["low"] for g in got) < 0.2
    assert len({g["silhouette"] for g in got}) == 4


def test_nulls_one_cluster_and_no_rows(spark):
    pts = _points(spark, 60)
    extra = spark.createDataFrame([(None, [1.0] * 3, 1), (900, None, 1), (901, [1.0] * 3, None)], pts.schema)
    assert cluster.silhouette_interval(pts.unionByName(extra), 999).first() == cluster.silhouette_interval(pts, 999).first()
    one = cluster.silhouette_interval(pts.withColumn("cluster", F.lit(1))).first()
    assert one["silhouette"] is None and one["n"] == 61
    assert cluster.silhouette_interval(pts.where("id < 0")).first()["n"] == 0
