"""Exact nearest neighbours of large tables by pivot (Voronoi) partitions.

Reference rows are dealt to the nearest of a set of pivots, and each cell is cut into rings by the distance
to its pivot, so that a partition holds a bounded number of rows and is described by its pivot and two
radii. A query first meets the partitions nearest to it that hold enough rows; the distance of its k-th
neighbour there is a bound, and of the other partitions it visits only those whose lower bound -- from the
ring's radii and from the plane between two pivots -- does not exceed it. Partitions meet their queries in groups of some
thousand rows (``grid_rows``): each (group, slice of its queries) is one ``cogroup`` group, to which a query
travels once with the list of its visits there; only k rows a query leave it.

Bounds: at most ``MAX_PIVOTS`` pivots, fitted on at most ``SAMPLE_PER_PIVOT`` rows each; about
``MAX_PIVOTS * RINGS`` partitions, whose description is all that reaches the driver. Beyond
``MAX_PARTITIONS * block_rows`` rows the partitions themselves grow. Of equal reference vectors only the
k (k + 1 with ``exclude_self``) smallest ids can be among the nearest, so the others are put aside first: a
vector that fills a third of the table costs no more than any other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.ml.pairwise import grid_rows, matrix, sq_distances
from tabprobe.session import cut_lineage

MAX_PIVOTS = 1_024
SAMPLE_PER_PIVOT = 16
RINGS = 64
MAX_PARTITIONS = MAX_PIVOTS * RINGS
LLOYD_STEPS = 6
TILE_CELLS = 1 << 22  # distances or bounds held at a time: 32 MB
#: part of the largest norm by which a computed distance may be off (expanded squares in doubles)
SLACK = 1e-6

NEIGHBOURS = "id long, ref_id long, sq double, label double"


def nearest_in_block(left: pd.DataFrame, right: pd.DataFrame, k: int, exclude_self: bool) -> pd.DataFrame:
    """The k nearest of ``right`` for every row of ``left``, ties to the smaller id. Expanded squares choose
    the candidates, with slack; the distances compared are sums of squared differences, which do not
    depend on how rows were put into blocks."""
    a, b = matrix(left["features"]), matrix(right["features"])
    lid, rid = left["id"].to_numpy(), right["id"].to_numpy()
    label = right["label"].to_numpy().astype("float64")
    norm = max((a * a).sum(1).max(), (b * b).sum(1).max())
    out = []
    step = max(1, TILE_CELLS // len(b))
    for lo in range(0, len(a), step):
        tile = a[lo:lo + step]
        d = sq_distances(tile, b)
        if exclude_self:
            d[lid[lo:lo + step, None] == rid[None, :]] = np.inf
        kk = min(k, d.shape[1])
        kth = np.partition(d, kk - 1, axis=1)[:, kk - 1]
        rows, cols = np.nonzero((d <= kth[:, None] + 1e-9 * norm) & np.isfinite(d))
        exact = np.empty(len(rows))
        for s in range(0, len(rows), 1 << 16):
            e = slice(s, s + (1 << 16))
            exact[e] = ((tile[rows[e]] - b[cols[e]]) ** 2).sum(1)
        order = np.lexsort((rid[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)  # rank inside the query's run
        keep = place < k
        out.append(pd.DataFrame({"id": lid[lo + rows[keep]], "ref_id": rid[cols[keep]],
                                 "sq": exact[keep], "label": label[cols[keep]]}))
    return pd.concat(out, ignore_index=True)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(sq_distances(x, pivots))


def fit_pivots(ref: DataFrame, n_pivots: int, seed: int = 42) -> np.ndarray:
    """Pivots: means of a few Lloyd steps over a bounded hash sample of the rows."""
    sample = (ref.select("features", F.xxhash64("id", F.lit(seed)).alias("_h"))
                 .orderBy("_h").limit(n_pivots * SAMPLE_PER_PIVOT).toPandas())
    x = matrix(sample["features"])
    pivots = x[:n_pivots].copy()
    for _ in range(LLOYD_STEPS):
        near = sq_distances(x, pivots).argmin(1)
        total = np.zeros_like(pivots)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=len(pivots))
        full = count > 0
        pivots[full] = total[full] / count[full, None]
    return np.unique(pivots, axis=0)


@dataclass
class Partitions:
    """Description of the reference partitions, in order of their number: pivot, ring radii, rows."""

    pivots: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def lower_bounds(self, x: np.ndarray) -> np.ndarray:
        """(queries, partitions): no row of the partition is nearer to the query than this."""
        pd_ = _distances(x, self.pivots)
        own = pd_.argmin(1)
        to_pivot = pd_[:, self.cell]
        ring = np.maximum(to_pivot - self.high, self.low - to_pivot)
        between = _distances(self.pivots, self.pivots)[own]
        gap = pd_ ** 2 - (pd_[np.arange(len(x)), own] ** 2)[:, None]
        plane = np.divide(gap, 2.0 * between, out=np.zeros_like(gap), where=between > 0)
        norm = np.sqrt(max((x * x).sum(1).max(), (self.pivots ** 2).sum(1).max()))
        reach = np.divide(pd_ + self.high.max(), between, out=np.zeros_like(gap), where=between > 0)
        plane_slack = SLACK * norm * (1.0 + reach)
        return np.maximum(np.maximum(ring - SLACK * (norm + self.high.max()), (plane - plane_slack)[:, self.cell]), 0.0)

    def step(self) -> int:
        """Queries whose bounds are held at a time."""
        return max(1, TILE_CELLS // max(len(self.cell), len(self.pivots)))


def partition_reference(ref: DataFrame, n_rows: int, block_rows: int) -> tuple[DataFrame, Partitions]:
    """(``ref`` with its partition number ``_part``, written once; the partitions)."""
    block_rows = max(block_rows, math.ceil(n_rows / MAX_PARTITIONS))
    pivots = fit_pivots(ref, max(1, min(MAX_PIVOTS, math.ceil(2 * n_rows / block_rows))))

    def deal(batches):
        for pdf in batches:
            x = matrix(pdf["features"]) if len(pdf) else np.zeros((0, pivots.shape[1]))
            cell, dist = np.zeros(len(x), dtype=np.int32), np.zeros(len(x))
            step = max(1, TILE_CELLS // len(pivots))
            for lo in range(0, len(x), step):
                d = _distances(x[lo:lo + step], pivots)
                cell[lo:lo + step] = d.argmin(1)
                dist[lo:lo + step] = d.min(1)
            yield pdf.assign(_cell=cell, _dist=dist)

    dealt = cut_lineage(ref.select("id", "features", "label").mapInPandas(
        deal, "id long, features array<double>, label double, _cell int, _dist double"))
    spark = ref.sparkSession
    grid = [i / RINGS for i in range(1, RINGS)]
    cells = dealt.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"),
                                       F.percentile_approx("_dist", grid, 1_000).alias("cuts")).collect()
    edges = []
    for r in cells:
        rings = min(RINGS, math.ceil(r["n"] / block_rows))
        edges.append((r["_cell"], [r["cuts"][i * RINGS // rings - 1] for i in range(1, rings)]))
    ringed = dealt.join(F.broadcast(spark.createDataFrame(edges, "_cell int, edges array<double>")), "_cell").withColumn(
        "_ring", F.size(F.filter("edges", lambda e: e < F.col("_dist")))).drop("edges")
    rings = ringed.groupBy("_cell", "_ring").agg(
        F.count(F.lit(1)).alias("n"), F.min("_dist").alias("low"), F.max("_dist").alias("high")).collect()
    numbers, parts = [], []
    for r in sorted(rings, key=lambda r: (r["_cell"], r["_ring"])):
        split = math.ceil(r["n"] / (2 * block_rows))  # rows at one distance: spread by id
        numbers.append((r["_cell"], r["_ring"], len(parts), split))
        # how many rows a hash share holds is not counted: 0 rows are claimed beyond one share
        parts += [(r["_cell"], r["low"], r["high"], r["n"] if split == 1 else 0)] * split
    of = spark.createDataFrame(numbers, "_cell int, _ring int, first int, split int")
    placed = ringed.join(F.broadcast(of), ["_cell", "_ring"]).select(
        "id", "features", "label",
        (F.col("first") + F.pmod(F.xxhash64("id"), F.col("split"))).cast("int").alias("_part"))
    cell, low, high, rows = (np.array(c) for c in zip(*parts))
    return placed, Partitions(pivots, cell, low, high, rows)


def _first_visits(parts: Partitions, need: int):
    """Per query the nearest partitions by lower bound that together hold ``need`` rows."""
    def run(batches):
        for pdf in batches:
            home = []
            x = matrix(pdf["features"]) if len(pdf) else None
            for lo in range(0, len(pdf), parts.step()):
                order = np.argsort(parts.lower_bounds(x[lo:lo + parts.step()]), axis=1, kind="stable")
                held = np.cumsum(parts.rows[order], axis=1)
                upto = np.minimum((held < need).sum(1) + 1, order.shape[1])
                home += [o[:n].astype(np.int32) for o, n in zip(order, upto)]
            yield pdf.assign(_visit=home)
    return run


def _later_visits(parts: Partitions):
    """Per query the partitions not met yet whose lower bound does not exceed its k-th distance."""
    def run(batches):
        for pdf in batches:
            rest = []
            x = matrix(pdf["features"]) if len(pdf) else None
            for lo in range(0, len(pdf), parts.step()):
                hi = lo + parts.step()
                open_ = parts.lower_bounds(x[lo:hi]) <= pdf["_kth"].to_numpy()[lo:hi, None]
                for i, met in enumerate(pdf["_visit"].iloc[lo:hi]):
                    open_[i, np.asarray(met, dtype=np.int64)] = False
                    rest.append(np.nonzero(open_[i])[0].astype(np.int32))
            yield pdf.drop(columns="_kth").assign(_visit=rest)
    return run


def _meet(queries: DataFrame, ref: DataFrame, k: int, exclude_self: bool, group_rows: int, width: int) -> DataFrame:
    """Neighbours of ``queries`` (id, features, _visit) in the partitions that they visit. Partitions meet in
    groups of ``width``: a query is copied once a group, with its visits there, and k rows a query leave the
    group. A group's queries are cut into slices of about ``group_rows``; its rows are copied once a
    slice, and only groups with visits take part."""
    group = lambda p: F.floor(p / width).cast("int")
    visits = queries.withColumn("_group", F.explode(F.array_distinct(F.transform("_visit", group))))
    counts = visits.groupBy("_group").agg(F.ceil(F.count(F.lit(1)) / F.lit(group_rows)).cast("int").alias("_slices"))
    slices = F.broadcast(counts)  # one row a group, at most about 2 * MAX_PARTITIONS
    q = (visits.select("id", "features", F.filter("_visit", lambda p: group(p) == F.col("_group")).alias("_visit"), "_group").join(slices, "_group")
               .withColumn("_slice", F.pmod(F.xxhash64("id"), F.col("_slices")).cast("int")).drop("_slices"))
    r = (ref.withColumn("_group", group(F.col("_part"))).join(slices, "_group")
            .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        best = pd.DataFrame({"id": [], "ref_id": [], "sq": [], "label": []})
        if left.empty or right.empty:
            return best
        row = np.repeat(np.arange(len(left)), left["_visit"].map(len))
        part, of = np.concatenate(left["_visit"].to_numpy()), right["_part"].to_numpy()
        found = []
        for p in np.unique(part):
            here = right[of == p]
            if len(here):
                found.append(nearest_in_block(left.iloc[row[part == p]], here, k, exclude_self))
        if not found:
            return best
        best = pd.concat(found, ignore_index=True).sort_values(["id", "sq", "ref_id"], ignore_index=True)
        return best[best.groupby("id", dropna=False).cumcount() < k]

    return q.groupBy("_group", "_slice").cogroup(r.groupBy("_group", "_slice")).applyInPandas(run, NEIGHBOURS)


def ranked(candidates: DataFrame, k: int) -> DataFrame:
    """The k first candidates of each query by squared distance, ties to the smaller id, with their rank."""
    w = Window.partitionBy("id").orderBy("sq", "ref_id")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_distance(neighbours: DataFrame) -> DataFrame:
    return neighbours.select("id", "ref_id", F.sqrt("sq").alias("dist"), "label", "rank")


def pivot_neighbours(query: DataFrame, ref: DataFrame, k: int, exclude_self: bool, block_rows: int,
                     ref_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """(neighbours (id, ref_id, dist, label, rank), visits (id, n partitions met), number of partitions). ``query``: id,
    features; ``ref``: also label. Ties in distance go to the smaller reference id."""
    need = k + (1 if exclude_self else 0)
    first = Window.partitionBy("features").orderBy("id")
    distinct = (ref.withColumn("_copy", F.row_number().over(first)).where(F.col("_copy") <= need).drop("_copy"))
    placed, parts = partition_reference(distinct, ref_rows, block_rows)
    # partitions stay small, so that bounds tell them apart; groups of them are as large as the blocks of all pairs
    group_rows = grid_rows(ref_rows, parts.pivots.shape[1], block_rows)
    width = max(1, math.ceil(len(parts.cell) * group_rows / max(ref_rows, 1)))
    home = cut_lineage(query.select("id", "features").mapInPandas(
        _first_visits(parts, need), "id long, features array<double>, _visit array<int>"))
    near = cut_lineage(ranked(_meet(home, placed, k, exclude_self, group_rows, width), k))
    kth = near.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max("sq")).alias("d")).select(
        "id", F.when(F.col("n") < k, F.lit(float("inf"))).otherwise(F.col("d")).alias("_kth"))
    bounded = home.join(kth, "id", "left").withColumn("_kth", F.coalesce("_kth", F.lit(float("inf"))))
    later = cut_lineage(bounded.select("id", "features", "_visit", "_kth").mapInPandas(
        _later_visits(parts), "id long, features array<double>, _visit array<int>"))
    far = _meet(later, placed, k, exclude_self, group_rows, width)
    visits = home.select("id", F.size("_visit").alias("n")).unionByName(
        later.select("id", F.size("_visit").alias("n"))).groupBy("id").agg(F.sum("n").alias("n"))
    return with_distance(ranked(near.drop("rank").unionByName(far), k)), visits, len(parts.cell)
