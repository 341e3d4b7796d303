"""Invariants for fitted models and the streaming ingest path."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprobe.ml import classify, cluster, metrics, prepare
from tabprobe.plans.fixtures import labeled_documents
from tabprobe.session import table

SF = "/root/testdata/sf0.01"
FEATS = ["n_chars", "text_len", "n_lines", "n_spaces", "toxic"]


def test_confusion_sums_to_n_and_metrics_consistent(spark):
    e = labeled_documents(spark, SF)
    split = prepare.stratified_split(e, "quality", ["doc_id"])
    tr, te = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    model = classify.train_classifier(tr, FEATS, "quality", "decision_tree", max_depth=4)
    pred = classify.predict(model, te, FEATS, "quality")
    cm = metrics.confusion_matrix(pred)
    assert cm.agg(F.sum("n")).first()[0] == te.count()
    acc = metrics.classification_metrics(pred).first()["accuracy"]
    diag = cm.where(F.col("label") == F.col("prediction")).agg(F.sum("n")).first()[0]
    assert acc == pytest.approx(diag / te.count())


def test_stratified_split_proportions(spark):
    e = labeled_documents(spark, SF)
    split = prepare.stratified_split(e, "quality", ["doc_id"]).groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()
    for r in split:
        assert r["t"] == round(0.3 * r["n"])


def test_kmeans_inertia_falls_and_centroids_are_means(spark):
    data, feats = prepare.prepare_clustering(labeled_documents(spark, SF), FEATS)
    costs = []
    for k in (2, 4, 6):
        m = cluster.train_kmeans(data, feats, k)
        costs.append(m.summary.trainingCost)
    assert costs[0] >= costs[1] >= costs[2]
    m = cluster.train_kmeans(data, feats, 3)
    assigned = cluster.assign_clusters(m, data, feats)
    means = assigned.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in feats]).collect()
    centers = m.clusterCenters()
    for r in means:
        assert np.allclose([r[c] for c in feats], centers[r["cluster"]], atol=1e-6)


def test_knn_exact_against_numpy(spark):
    e = table(spark, "/root/testdata/sf0.001", "embeddings")
    pts = e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"),
                   F.col("label").cast("double").alias("label"))
    got = {r["id"]: r["prediction"] for r in
           classify.knn_classify(pts.select("id", "features"), pts, k=5, exclude_self=True,
                                 block_rows=128).collect()}
    pdf = pts.toPandas()
    x = np.vstack(pdf["features"].to_numpy())
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    ids = pdf["id"].to_numpy()
    for i in range(len(ids)):
        order = np.lexsort((ids, d[i]))[:5]
        labels = pdf["label"].to_numpy()[order]
        vals, counts = np.unique(labels, return_counts=True)
        assert got[ids[i]] == vals[np.argmax(counts)]


def test_streaming_ingest_tokens(spark):
    from tabprobe.streaming.ingest import read_delimited_stream
    d = tempfile.mkdtemp(prefix="tabprobe-stream-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("a,b\n1,?\nNA,x\n3,NONE\n")
    q = (read_delimited_stream(spark, d, ["a", "b"]).writeStream.format("memory")
         .queryName("ingest_test").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    rows = sorted(spark.sql("SELECT * FROM ingest_test").collect(), key=lambda r: str(r["a"]))
    assert [(r["a"], r["b"]) for r in rows] == [("1", None), ("3", None), (None, "x")]
