"""Classifiers (M4-M8) and cross-validation (M12) on ``pyspark.ml``.

Parameters go by the reference's names and are translated. The kernel SVM
has no Spark counterpart: an RBF kernel is approximated with random Fourier
features (Rahimi & Recht, 2007) in front of ``LinearSVC`` -- an approximation,
stated as such.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.ml.metrics import classification_metrics
from tabprobe.ml.pairwise import DEFAULT_BLOCK_ROWS, blocked
from tabprobe.ml.pivots import NEIGHBOURS, nearest_in_block, pivot_neighbours, ranked, with_distance
from tabprobe.ml.prepare import assemble, fold_assignment
from tabprobe.session import cut_lineage

MODEL_TYPES = ("logistic", "decision_tree", "random_forest", "svc", "knn")
WEIGHTS = ("uniform", "distance")


#: parameter names of the reference's library and their Spark counterparts
PARAMETERS = {
    "logistic": {"C": None, "max_iter": "maxIter", "tol": "tol", "fit_intercept": "fitIntercept", "random_state": None},
    "decision_tree": {"criterion": "impurity", "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode",
                      "min_impurity_decrease": "minInfoGain", "random_state": "seed"},
    "random_forest": {"n_estimators": "numTrees", "criterion": "impurity", "max_depth": "maxDepth",
                      "min_samples_leaf": "minInstancesPerNode", "min_impurity_decrease": "minInfoGain",
                      "max_features": "featureSubsetStrategy", "random_state": "seed"},
    "svc": {"C": None, "kernel": None, "gamma": None, "max_iter": None, "random_state": None, "dim": None},
    "knn": {"n_neighbors": None, "weights": None},
}
IMPURITY = {"gini": "gini", "entropy": "entropy", "log_loss": "entropy"}
PROJECT_ROWS = 512  # rows projected at a time
MAX_DEPTH = 30  # Spark's own limit


def spark_parameters(model_type: str, params: dict) -> dict:
    """Estimator arguments from parameters under the reference's names; an
    unknown name or a value without a counterpart raises ``ValueError``."""
    known = PARAMETERS[model_type]
    out = {}
    for name, value in params.items():
        if name not in known:
            raise ValueError(f"{model_type} has no parameter {name!r}; known: {', '.join(known)}")
        if name == "criterion":
            if value not in IMPURITY:
                raise ValueError(f"unknown criterion {value!r}")
            value = IMPURITY[value]
        elif name == "max_depth":
            value = min(value or MAX_DEPTH, MAX_DEPTH)
        elif name == "max_features":
            value = "all" if value is None else str(value)
        elif name == "random_state" and value is None:
            continue
        if known[name]:
            out[known[name]] = value
    return out


def _logistic(n_rows: int, params: dict):
    # C-penalised L2 logistic loss == regParam = 1 / (C * n) on Spark's mean loss
    return LogisticRegression(**{"regParam": 1.0 / (params.get("C", 1.0) * max(n_rows, 1)), "elasticNetParam": 0.0,
                                 "standardization": False, "maxIter": 100} | spark_parameters("logistic", params))


def _decision_tree(params: dict):
    return DecisionTreeClassifier(**{"maxDepth": MAX_DEPTH, "seed": 42} | spark_parameters("decision_tree", params))


def _random_forest(params: dict):
    return RandomForestClassifier(**{"numTrees": 100, "maxDepth": MAX_DEPTH, "seed": 42} | spark_parameters("random_forest", params))


class FourierFeatures:
    """RBF kernel approximation: z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma)."""

    def __init__(self, n_features: int, dim: int = 200, gamma: float | None = None, seed: int = 42):
        rng = np.random.default_rng(seed)
        g = gamma if gamma is not None else 1.0 / max(n_features, 1)
        self.w = rng.normal(0.0, np.sqrt(2.0 * g), size=(n_features, dim))
        self.b = rng.uniform(0.0, 2.0 * np.pi, size=dim)
        self.scale = np.sqrt(2.0 / dim)

    def transform(self, df: DataFrame, col: str = "features", out: str = "features") -> DataFrame:
        w, b, s = self.w, self.b, self.scale

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def project(v: pa.Array) -> pa.Array:
            """A flat buffer of values, filled a few rows at a time: no object per row, no copy of the batch."""
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), len(w)).astype(np.float64)
            z = np.empty((len(x), len(b)))
            for lo in range(0, len(x), PROJECT_ROWS):
                part = x[lo:lo + PROJECT_ROWS] @ w
                part += b
                np.multiply(np.cos(part, out=part), s, out=z[lo:lo + PROJECT_ROWS])
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(b)), pa.array(z.reshape(-1)))

        arr = df.withColumn("_fx", vector_to_array(F.col(col)))
        return arr.withColumn(out, array_to_vector(project("_fx"))).drop("_fx")


class SVC:
    """Support vector machine on ``LinearSVC`` (one-vs-rest when k > 2):
    ``kernel="linear"`` as it is, ``"rbf"`` approximated by Fourier features.
    ``gamma``: a number, ``"scale"`` (1 / (features x variance of all values)) or ``"auto"``
    (1 / features)."""

    def __init__(self, n_rows: int, n_classes: int, C: float = 1.0, kernel: str = "rbf", gamma: float | str = "scale",
                 dim: int = 200, random_state: int = 42, max_iter: int = 100):
        if kernel not in ("linear", "rbf"):
            raise ValueError(f"unknown kernel {kernel!r}")
        if isinstance(gamma, str) and gamma not in ("scale", "auto"):
            raise ValueError(f"unknown gamma {gamma!r}")
        self.kernel, self.gamma, self.dim, self.seed = kernel, gamma, dim, random_state
        # C-penalised hinge loss == regParam = 1 / (C * n) on Spark's mean loss
        svc = LinearSVC(regParam=1.0 / (C * max(n_rows, 1)), maxIter=max_iter, standardization=False)
        self.est = svc if n_classes <= 2 else OneVsRest(classifier=svc)
        self.ff = self.model = None

    def _mapped(self, df: DataFrame) -> DataFrame:
        return df if self.ff is None else self.ff.transform(df)

    def fit(self, df: DataFrame):
        if self.kernel == "rbf":
            v = vector_to_array(F.col("features"))
            n, gamma = len(df.select(v.alias("v")).first()[0]), self.gamma
            if gamma == "auto":
                gamma = 1.0 / max(n, 1)
            elif gamma == "scale":
                var = df.select(F.explode(v).alias("x")).agg(F.var_pop("x")).first()[0]
                gamma = 1.0 / (n * var) if var else 1.0
            self.ff = FourierFeatures(n, self.dim, gamma, self.seed)
        self.model = self.est.fit(self._mapped(df))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self._mapped(df))


class KNN:
    """Exact nearest neighbours behind the same calls as the other models."""

    def __init__(self, n_neighbors: int = 5, weights: str = "uniform"):
        if weights not in WEIGHTS:
            raise ValueError(f"unknown weights {weights!r}")
        self.k, self.weights, self.ref = n_neighbors, weights, None

    def fit(self, df: DataFrame):
        self.ref = cut_lineage(df.select(F.monotonically_increasing_id().alias("id"),
                                         vector_to_array("features").alias("features"), "label"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        query = cut_lineage(df.withColumn("_id", F.monotonically_increasing_id()))  # ids written once
        pred = knn_classify(query.select(F.col("_id").alias("id"), vector_to_array("features").alias("features")),
                            self.ref, self.k, weights=self.weights)
        return query.join(pred.withColumnRenamed("id", "_id"), "_id", "left").drop("_id")


def train_classifier(train: DataFrame, features: Sequence[str], label: str = "label",
                     model_type: str = "logistic", **params):
    """M4-M8: fit a classifier on numeric ``features``; returns a fitted model
    whose ``transform`` adds ``prediction``. ``params`` go by the reference's names
    (``PARAMETERS``)."""
    if model_type not in MODEL_TYPES:
        raise ValueError(f"unknown model type {model_type!r}")
    spark_parameters(model_type, params)  # names are checked first
    data = assemble(train, features).withColumn("label", F.col(label).cast("double"))
    if model_type == "logistic":
        return _logistic(data.count(), params).fit(data)
    if model_type == "decision_tree":
        return _decision_tree(params).fit(data)
    if model_type == "random_forest":
        return _random_forest(params).fit(data)
    if model_type == "knn":
        return KNN(**params).fit(data)
    size = data.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("k")).first()
    return SVC(size["n"], size["k"], **params).fit(data)


def predict(model, test: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    data = assemble(test, features).withColumn("label", F.col(label).cast("double"))
    return model.transform(data).select(*[F.col(c) for c in test.columns if c != "label"],
                                        "label", F.col("prediction").cast("double"))


# ------------------------------------------------------------------ kNN

def knn_neighbours(query: DataFrame, ref: DataFrame, k: int = 5, exclude_self: bool = False,
                   block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Exact k nearest reference rows (Euclidean) for every query row:
    (id, ref_id, dist, label, rank). Both inputs: ``id``, ``features``
    (array<double>); ``ref`` also ``label``. Ties in distance go to the
    smaller reference id."""
    nq, nr = query.count(), ref.count()  # sizes pick the block counts
    if nr > block_rows:
        return pivot_neighbours(query, ref, k, exclude_self, block_rows, nr)[0]

    # one reference block: every query meets it once
    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return nearest_in_block(left, right, k, exclude_self)

    cand = blocked(query.select("id", "features"), ref.select("id", "features", "label"), nearest,
                   NEIGHBOURS, nq, nr, block_rows)
    return with_distance(ranked(cand, k))


def knn_classify(query: DataFrame, ref: DataFrame, k: int = 5, exclude_self: bool = False,
                 block_rows: int = DEFAULT_BLOCK_ROWS, weights: str = "uniform") -> DataFrame:
    """M8: vote of the k nearest, each counting 1 (``uniform``) or the inverse of
    its distance (``distance``; neighbours at distance 0 alone decide); a tied
    vote goes to the smallest label. Returns (id, prediction)."""
    if weights not in WEIGHTS:
        raise ValueError(f"unknown weights {weights!r}")
    nb = knn_neighbours(query, ref, k, exclude_self, block_rows)
    vote = F.lit(1.0)
    if weights == "distance":
        near = F.min("dist").over(Window.partitionBy("id"))
        nb = nb.withColumn("_zero", near == 0)
        vote = F.when(F.col("_zero"), (F.col("dist") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("dist")))
    votes = nb.groupBy("id", "label").agg(F.sum(vote).alias("votes"))
    w = Window.partitionBy("id").orderBy(F.col("votes").desc(), F.col("label").asc())
    return (votes.withColumn("_r", F.row_number().over(w)).where("_r = 1")
                 .select("id", F.col("label").alias("prediction")))


# ------------------------------------------------------------------ cross-validation

def cross_validate(data: DataFrame, features: Sequence[str], label: str, id_cols: Sequence[str],
                   model_type: str = "logistic", folds: int = 5, parallelism: int = 4, **params) -> DataFrame:
    """Stratified ``folds``-fold accuracy with refits, plus the mean and the
    population std as extra rows (fold = -1 / -2). The reference folds its test
    split; the input set is an argument here. ``parallelism`` folds are fitted side by side."""
    assigned = cut_lineage(fold_assignment(data, label, id_cols, folds))

    def accuracy(f: int) -> float:
        tr = assigned.where(F.col("fold") != f)
        te = assigned.where(F.col("fold") == f)
        model = train_classifier(tr, features, label, model_type, **params)
        m = classification_metrics(predict(model, te, features, label)).first()
        return float(m["accuracy"])

    run = inheritable_thread_target(data.sparkSession)(accuracy)
    with ThreadPoolExecutor(max(1, min(parallelism, folds))) as pool:
        accs = list(pool.map(run, range(folds)))
    mean = float(np.mean(accs))
    std = float(np.std(accs))
    rows = [(f, a) for f, a in enumerate(accs)] + [(-1, mean), (-2, std)]
    return data.sparkSession.createDataFrame(rows, "fold int, accuracy double")
