"""K-means for several numbers of clusters in shared passes over the data.

Every pass reads the rows once and advances all models that have not converged: a task adds up, per model
and cluster, the rows, vectors and costs under the model's present centres, and only these sums are
shuffled. Models start from k-means++ centres of a bounded hash sample, moved to rest on that sample, so few
passes over all rows follow. The squared-Euclidean silhouettes of all models take one further pass: with a
cluster's size, vector sum and sum of squared norms, the mean squared distance of a row to it is closed-form.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.ml.pairwise import matrix, sq_distances

START_ROWS = 8_192  # sample that the starting centres are fitted on
TOLERANCE = 1e-4    # a model rests when no centre moves further
TILE_CELLS = 1 << 22


@dataclass
class Model:
    """Centres and, under them, each cluster's rows, vector sum, sum of squared norms, and the whole cost.
    Vectors are relative to ``origin``, so that sums of squares lose no digits far from zero."""

    origin: np.ndarray
    centers: np.ndarray
    rows: np.ndarray | None = None
    sums: np.ndarray | None = None
    squares: np.ndarray | None = None
    inertia: float = 0.0
    passes: int = 0

    def moved(self) -> np.ndarray:
        """The means of the clusters; an empty cluster keeps its centre."""
        full = self.rows > 0
        out = self.centers.copy()
        out[full] = self.sums[full] / self.rows[full, None]
        return out


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the nearest centre (ties: the first) and the squared distance to it."""
    near, cost = np.zeros(len(x), np.int64), np.zeros(len(x))
    step = max(1, TILE_CELLS // len(centers))
    for lo in range(0, len(x), step):
        d = sq_distances(x[lo:lo + step], centers)
        near[lo:lo + step], cost[lo:lo + step] = d.argmin(1), d.min(1)
    return near, cost


def spread_start(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each centre is drawn with the squared distance to the nearest one before as its weight."""
    centers = [x[rng.integers(len(x))]]
    d = sq_distances(x, centers[0][None])[:, 0]
    while len(centers) < k and d.sum() > 0:
        centers.append(x[rng.choice(len(x), p=d / d.sum())])
        d = np.minimum(d, sq_distances(x, centers[-1][None])[:, 0])
    return np.array(centers)


def _rest(x: np.ndarray, centers: np.ndarray, steps: int) -> np.ndarray:
    for _ in range(steps):
        near, _cost = _nearest(x, centers)
        rows = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        new = np.where(rows[:, None] > 0, sums / np.maximum(rows, 1)[:, None], centers)
        still = ((new - centers) ** 2).sum(1).max() <= TOLERANCE ** 2
        centers = new
        if still:
            break
    return centers


def starts(points: DataFrame, ks: Sequence[int], seed: int, max_iter: int) -> dict[int, Model]:
    """A starting model for every k. With fewer different sampled rows than k a model has that many centres."""
    sample = (points.select("features", F.xxhash64("features", F.lit(seed)).alias("_h"))
                    .orderBy("_h").limit(START_ROWS).toPandas())
    if sample.empty:
        return {}
    x = matrix(sample["features"])
    origin = x.mean(0)
    x = x - origin
    return {k: Model(origin, _rest(x, spread_start(x, k, np.random.default_rng(seed)), max_iter)) for k in ks}


def measure(points: DataFrame, models: dict[int, Model]) -> None:
    """One pass: the sums of every given model under its present centres."""
    shared = [(k, m.origin, m.centers) for k, m in models.items()]

    def add_up(batches):
        held = {}
        for pdf in batches:
            if not len(pdf):
                continue
            raw = matrix(pdf["features"])
            for k, origin, centers in shared:
                x = raw - origin
                near, cost = _nearest(x, centers)
                if k not in held:
                    held[k] = (np.zeros(len(centers), np.int64), np.zeros_like(centers), np.zeros((2, len(centers))))
                rows, sums, more = held[k]
                rows += np.bincount(near, minlength=len(centers))
                np.add.at(sums, near, x)
                more[0] += np.bincount(near, (x * x).sum(1), len(centers))
                more[1] += np.bincount(near, cost, len(centers))
        for k, (rows, sums, more) in held.items():
            c = np.flatnonzero(rows)
            yield pd.DataFrame({"k": k, "c": c, "n": rows[c], "v": list(np.hstack([sums[c], more[:, c].T]))})

    parts = points.select("features").mapInPandas(add_up, "k int, c int, n long, v array<double>")
    total = parts.groupBy("k", "c").agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("v")).alias("v")).select(
        "k", "c", "n", vector_to_array("v").alias("v")).collect()  # one row a model and cluster
    for m in models.values():
        m.rows, m.sums, m.squares = np.zeros(len(m.centers), np.int64), np.zeros_like(m.centers), np.zeros(len(m.centers))
        m.inertia = 0.0
        m.passes += 1
    for r in total:
        m = models[r["k"]]
        m.rows[r["c"]], m.sums[r["c"]], m.squares[r["c"]] = r["n"], r["v"][:-2], r["v"][-2]
        m.inertia += r["v"][-1]


def fit_many(points: DataFrame, models: dict[int, Model], max_iter: int = 300) -> dict[int, Model]:
    """Lloyd's steps over all rows for every model at once, until none moves or ``max_iter`` passes. The
    sums of a returned model are those under its returned centres. ``points``: features (array<double>)."""
    active = dict(models)
    for turn in range(max_iter):
        if not active:
            break
        measure(points, active)
        for k, m in list(active.items()):
            new = m.moved()
            if ((new - m.centers) ** 2).sum(1).max() <= TOLERANCE ** 2:
                del active[k]
            elif turn + 1 < max_iter:
                m.centers = new
    return models


def silhouettes_sq(points: DataFrame, models: dict[int, Model]) -> dict[int, float | None]:
    """Mean squared-Euclidean silhouette of every model, in one pass; None with fewer than two clusters that
    hold rows. A row alone in its cluster counts 0."""
    shared = {k: (m.origin, m.centers, m.rows, m.sums, m.squares) for k, m in models.items() if (m.rows > 0).sum() > 1}

    def add_up(batches):
        held = dict.fromkeys(shared, 0.0)
        for pdf in batches:
            if not len(pdf):
                continue
            raw = matrix(pdf["features"])
            for k, (origin, centers, rows, sums, squares) in shared.items():
                n = np.maximum(rows, 1)
                step = max(1, TILE_CELLS // len(centers))
                for lo in range(0, len(raw), step):
                    x = raw[lo:lo + step] - origin
                    at, (own, _cost) = np.arange(len(x)), _nearest(x, centers)
                    d = (x * x).sum(1)[:, None] + squares / n - 2.0 * x @ (sums / n[:, None]).T
                    d = np.where(rows > 0, np.maximum(d, 0.0), np.inf)
                    a = d[at, own] * rows[own] / np.maximum(rows[own] - 1, 1)
                    d[at, own] = np.inf
                    b = d.min(1)
                    top = np.maximum(a, b)
                    s = np.divide(b - a, top, out=np.zeros_like(a), where=top > 0)
                    held[k] += s[rows[own] > 1].sum()
        yield pd.DataFrame({"k": list(held), "s": list(held.values())})

    out: dict[int, float | None] = dict.fromkeys(models)
    if shared:
        for r in points.select("features").mapInPandas(add_up, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
            out[r["k"]] = r["s"] / int(models[r["k"]].rows.sum())
    return out


def assigned(points: DataFrame, models: dict[int, Model]) -> DataFrame:
    """``points`` (id, features) with ``clusters``: the row's cluster in every model, in the order of ``models``."""
    shared = [(m.origin, m.centers) for m in models.values()]

    def run(batches):
        for pdf in batches:
            raw = matrix(pdf["features"]) if len(pdf) else None
            near = [_nearest(raw - origin, centers)[0] for origin, centers in shared] if len(pdf) else []
            yield pdf.assign(clusters=list(np.column_stack(near).astype(np.int32)) if len(pdf) else [])
    return points.select("id", "features").mapInPandas(run, "id long, features array<double>, clusters array<int>")
