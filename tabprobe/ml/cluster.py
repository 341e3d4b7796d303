"""K-means (M14-M17) and cluster plot data."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.functions.columns import hash_order_key
from tabprobe.ml import lloyd
from tabprobe.ml.pairwise import TILE_CELLS, blocked, equal_ids, grid_rows, matrix, sq_distances
from tabprobe.ml.prepare import assemble
from tabprobe.session import cut_lineage

KMEANS_SEED = 42


def train_kmeans(data: DataFrame, features: Sequence[str], k: int, seed: int = KMEANS_SEED,
                 max_iter: int = 300):
    """``ml.KMeans`` (k-means|| initialisation), seed 42."""
    return KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features").fit(assemble(data, features))


def assign_clusters(model, data: DataFrame, features: Sequence[str]) -> DataFrame:
    return model.transform(assemble(data, features)).withColumnRenamed("prediction", "cluster")


def clustering_metrics(model, data: DataFrame, features: Sequence[str]) -> DataFrame:
    """(cluster, size, centroid, inertia) -- sizes from one grouped count,
    inertia = the model's training cost (sum of squared distances)."""
    sizes = assign_clusters(model, data, features).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"))
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    cdf = data.sparkSession.createDataFrame(centers, "cluster int, centroid array<double>")
    return (cdf.join(sizes, "cluster", "left")
               .select("cluster", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "centroid",
                       F.lit(float(model.summary.trainingCost)).alias("inertia"))
               .orderBy("cluster"))


def silhouettes_points(points: DataFrame, block_rows: int | None = None) -> DataFrame:
    """M16 (exact) for several clusterings at once: (model, id, silhouette) with Euclidean distances.

    ``points``: (id, features array<double>, clusters array<int>: the cluster in each model). Every point block
    meets every reference block once; each meeting computes its distances once, tile by tile, and emits one
    (model, point, cluster) partial distance sum, so nothing quadratic is materialised. Blocks hold
    ``block_rows`` rows, by default as ``grid_rows`` says."""
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("dims")).first()
    n = size["n"]
    if block_rows is None:
        block_rows = grid_rows(n, size["dims"] or 1)

    def partial(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b, ids = matrix(left["features"]), matrix(right["features"]), left["id"].to_numpy()
        same_left, same_right = equal_ids(ids, right["id"].to_numpy())
        out = []
        models = [np.unique(cl, return_inverse=True) for cl in np.vstack(right["clusters"].to_numpy()).T]
        sums = [np.empty((len(a), len(names))) for names, _ in models]
        step = max(1, TILE_CELLS // len(b))
        for lo in range(0, len(a), step):
            d = np.sqrt(sq_distances(a[lo:lo + step], b))
            here = (same_left >= lo) & (same_left < lo + step)
            d[same_left[here] - lo, same_right[here]] = 0.0
            for (names, at), s in zip(models, sums):
                for c in range(len(names)):
                    s[lo:lo + step, c] = d[:, at == c].sum(1)
        for model, ((names, at), s) in enumerate(zip(models, sums)):
            held = np.tile(np.bincount(at, minlength=len(names)), (len(a), 1))
            np.subtract.at(held, (same_left, at[same_right]), 1)
            for c, name in enumerate(names):
                out.append(pd.DataFrame({"model": model, "id": ids, "other": int(name), "s": s[:, c], "c": held[:, c].astype("int64")}))
        return pd.concat(out, ignore_index=True)

    sums = blocked(points.select("id", "features"), points.select("id", "features", "clusters"),
                   partial, "model int, id long, other int, s double, c long", n, n, block_rows)
    per = sums.groupBy("model", "id", "other").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    own = points.select("id", F.posexplode("clusters").alias("model", "own"))
    j = per.join(own, ["model", "id"])
    mean = F.try_divide(F.col("s"), F.col("c"))  # 0/0 for a singleton cluster
    agg = j.groupBy("model", "id").agg(
        F.max(F.when(F.col("other") == F.col("own"), F.col("c"))).alias("n_own"),
        F.max(F.when(F.col("other") == F.col("own"), mean)).alias("a"),
        F.min(F.when((F.col("other") != F.col("own")) & (F.col("c") > 0), mean)).alias("b"))
    sil = F.when(F.coalesce(F.col("n_own"), F.lit(0)) == 0, F.lit(0.0)).otherwise(
        (F.col("b") - F.col("a")) / F.greatest(F.col("a"), F.col("b")))
    return agg.select("model", "id", sil.alias("silhouette"))


def silhouette_points(points: DataFrame, block_rows: int | None = None) -> DataFrame:
    """M16 (exact): per-point silhouette. ``points``: (id, features array<double>, cluster)."""
    one = points.select("id", "features", F.array(F.col("cluster").cast("int")).alias("clusters"))
    return silhouettes_points(one, block_rows).drop("model")


def silhouette(points: DataFrame, block_rows: int | None = None) -> DataFrame:
    """One row, mean exact Euclidean silhouette."""
    return silhouette_points(points, block_rows).agg(F.avg("silhouette").alias("silhouette"))


def silhouette_interval(points: DataFrame, sample_rows: int = 2_048, confidence: float = 0.95,
                        seed: int = KMEANS_SEED) -> DataFrame:
    """M16 in linear time: one row (silhouette, low, high, sampled, n): an estimate of the mean Euclidean
    silhouette with its interval of the given confidence (normal approximation, finite-population corrected; with
    small samples of skewed silhouettes it holds the exact value a little less often than stated).

    From every cluster a share of about ``sample_rows`` points in proportion to its size (at least 2, hash
    order) is drawn; their own silhouettes are exact, as each is measured against **all** points: tasks add
    up the distances of their rows to the sampled ones per cluster, and no row is shuffled. A sample that holds
    every row gives the exact value and an interval of no width. ``points``: (id, features array<double>, cluster);
    rows with a null among them take no part; no rows or a single cluster give a null silhouette."""
    rows = points.where("id IS NOT NULL AND features IS NOT NULL AND cluster IS NOT NULL")
    sizes = dict(tuple(r) for r in rows.groupBy("cluster").count().orderBy("cluster").collect())  # one row a cluster
    spark, n = points.sparkSession, sum(sizes.values())
    schema = "silhouette double, low double, high double, sampled long, n long"
    if len(sizes) < 2:
        return spark.createDataFrame([(None, None, None, 0, n)], schema)
    shares = {c: min(m, max(2, math.ceil(sample_rows * m / n))) for c, m in sizes.items()}
    share = spark.createDataFrame(list(shares.items()), T.StructType([rows.schema["cluster"], T.StructField("_m", T.LongType())]))
    nth = F.row_number().over(Window.partitionBy("cluster").orderBy(hash_order_key(["id"], seed), "id"))
    sample = (rows.select("id", "features", "cluster").withColumn("_n", nth).where(F.col("_n") <= max(shares.values()))
                  .join(F.broadcast(share), "cluster").where("_n <= _m").toPandas())
    at = {c: i for i, c in enumerate(sizes)}
    sampled, ids, own = matrix(sample["features"]), sample["id"].to_numpy(), sample["cluster"].map(at).to_numpy()

    def add_up(batches):
        sums = np.zeros((len(sampled), len(at)))
        for pdf in batches:
            step = max(1, lloyd.TILE_CELLS // len(sampled))
            for lo in range(0, len(pdf), step):
                part = pdf.iloc[lo:lo + step]
                d = np.sqrt(sq_distances(sampled, matrix(part["features"])))
                d[ids[:, None] == part["id"].to_numpy()[None, :]] = 0.0
                cl = part["cluster"].map(at).to_numpy()
                for c in np.unique(cl):
                    sums[:, c] += d[:, cl == c].sum(1)
        yield pd.DataFrame({"i": np.arange(len(sampled)), "s": list(sums)})

    parts = rows.select("id", "features", "cluster").mapInPandas(add_up, "i int, s array<double>")
    total = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("s")).alias("s")).orderBy("i").select(
        vector_to_array("s").alias("s")).toPandas()  # one row a sampled point
    count, here = np.array(list(sizes.values())), np.arange(len(sampled))
    mean = matrix(total["s"]) / count
    a = mean[here, own] * count[own] / np.maximum(count[own] - 1, 1)
    mean[here, own] = np.inf
    b = mean.min(1)
    top = np.maximum(a, b)
    s = np.where(count[own] > 1, np.divide(b - a, top, out=np.zeros_like(a), where=top > 0), 0.0)
    value = variance = 0.0
    for c, m in enumerate(count):
        mine = s[own == c]
        value += m / n * mine.mean()
        if len(mine) < m:
            variance += (m / n) ** 2 * mine.var(ddof=1) / len(mine) * (1 - len(mine) / m)
    half = NormalDist().inv_cdf(0.5 + confidence / 2) * math.sqrt(variance)
    return spark.createDataFrame([(float(value), float(value - half), float(value + half), len(s), n)], schema)


def silhouette_sq_euclidean(model, data: DataFrame, features: Sequence[str]) -> float:
    """Spark's own (squared-Euclidean) silhouette: a different number, named as such."""
    pred = model.transform(assemble(data, features))
    return float(ClusteringEvaluator(featuresCol="features", predictionCol="prediction",
                                     distanceMeasure="squaredEuclidean").evaluate(pred))


def with_point_ids(data: DataFrame, features: Sequence[str], id_col: str | None = None) -> DataFrame:
    """(id, features array<double>) view for the pairwise kernels."""
    ident = F.col(id_col).cast("long") if id_col else F.monotonically_increasing_id()
    return data.select(ident.alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("features"),
                       *[F.col(c) for c in data.columns if c not in features and c != id_col])


MEASURES = ("squared_euclidean", "exact")


def choose_k(data: DataFrame, features: Sequence[str], ks: Sequence[int] = range(2, 11),
             id_col: str | None = None, seed: int = KMEANS_SEED, measure: str = "squared_euclidean",
             max_iter: int = 300) -> DataFrame:
    """(k, inertia, and one silhouette column) for each candidate k. All models are trained in
    shared passes over the data and measured in one more (``tabprobe.ml.lloyd``). ``measure``:
    ``squared_euclidean`` is linear in the rows (column ``silhouette_sq``); ``exact`` computes all distances,
    once for all k (column ``silhouette``). Rows with a missing feature take no part; a silhouette is null
    when fewer than two clusters hold rows; an empty table gives no rows."""
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}")
    name = "silhouette" if measure == "exact" else "silhouette_sq"
    values = F.array(*[F.col(c).cast("double") for c in features])
    ident = F.monotonically_increasing_id() if id_col is None else F.col(id_col).cast("long")
    points = data.select(ident.alias("id"), values.alias("features")).where(
        F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x)))
    base = cut_lineage(points)  # written once: ids and every pass see the same rows
    models = lloyd.fit_many(base, lloyd.starts(base, list(dict.fromkeys(ks)), seed, max_iter), max_iter)
    if measure == "exact" and models:
        per = silhouettes_points(cut_lineage(lloyd.assigned(base, models)))
        means = {r["model"]: r["s"] for r in per.groupBy("model").agg(F.avg("silhouette").alias("s")).collect()}
        quality = {k: means.get(i) for i, k in enumerate(models)}
    else:
        quality = lloyd.silhouettes_sq(base, models)
    rows = [(int(k), float(m.inertia), quality[k]) for k, m in models.items()]
    return data.sparkSession.createDataFrame([(k, i, None if s is None else float(s)) for k, i, s in rows],
                                             f"k int, inertia double, {name} double")


def cluster_points(model, data: DataFrame, features: Sequence[str], x: str, y: str,
                   id_cols: Sequence[str] | None = None, max_points: int | None = None) -> DataFrame:
    """(x, y, cluster, is_centroid) -- all points (or a hash sample of
    ``max_points``) on the two chosen features plus one row per centroid."""
    from tabprobe.operators.chartdata import sample_key
    pred = assign_clusters(model, data, features)
    pts = pred.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
                      F.col("cluster").cast("int").alias("cluster"), F.lit(False).alias("is_centroid"),
                      sample_key(id_cols or list(data.columns)).alias("_key"))
    if max_points is not None:
        pts = pts.orderBy("_key").limit(max_points)
    pts = pts.drop("_key")
    ix, iy = list(features).index(x), list(features).index(y)
    cents = [(float(c[ix]), float(c[iy]), i, True) for i, c in enumerate(model.clusterCenters())]
    cdf = data.sparkSession.createDataFrame(cents, "x double, y double, cluster int, is_centroid boolean")
    return pts.unionByName(cdf)
