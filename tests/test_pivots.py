"""Exact nearest neighbours by pivot partitions against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprobe.ml import classify, pivots


def _frame(spark, x, label=None, ids=None):
    ids = range(len(x)) if ids is None else ids
    label = np.zeros(len(x)) if label is None else label
    return spark.createDataFrame([(int(i), [float(c) for c in v], float(t)) for i, v, t in zip(ids, x, label)],
                                 "id long, features array<double>, label double")


def _brute(q, qid, r, rid, k, exclude_self):
    out = set()
    for i, v in zip(qid, q):
        d = ((r - v) ** 2).sum(1)
        order = [j for j in np.lexsort((rid, d)) if not (exclude_self and rid[j] == i)][:k]
        out |= {(int(i), int(rid[j]), n + 1) for n, j in enumerate(order)}
    return out


def _rows(df):
    return {(r["id"], r["ref_id"], r["rank"]) for r in df.collect()}


def _clustered(n, clusters, dims=6, seed=1):
    rng = np.random.default_rng(seed)
    return rng.uniform(-50, 50, (clusters, dims))[rng.integers(0, clusters, n)] + rng.normal(0, 0.3, (n, dims))


def test_clustered_rows_visit_few_partitions(spark):
    x = _clustered(800, 16)
    ids = np.arange(800)
    df = _frame(spark, x)
    got, visits, n_parts = pivots.pivot_neighbours(df.select("id", "features"), df, 5, True, 64, 800)
    assert _rows(got) == _brute(x, ids, x, ids, 5, True)
    met = visits.toPandas()["n"]
    assert len(met) == 800 and n_parts >= 12
    assert met.mean() < n_parts / 4


def test_copies_that_fill_a_third_and_ties(spark):
    x = _clustered(400, 6, dims=3, seed=2)
    x[::3] = x[0]                      # a third of the rows are one vector
    x[1::30] = np.round(x[1::30])      # some share distances
    ids = np.random.default_rng(3).permutation(400)
    df = _frame(spark, x, ids=ids)
    got, visits, n_parts = pivots.pivot_neighbours(df.select("id", "features"), df, 4, True, 32, 400)
    assert _rows(got) == _brute(x, ids, x, ids, 4, True)


def test_rows_at_one_distance_from_the_pivot(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    x /= np.linalg.norm(x, axis=1)[:, None]  # a circle
    q = np.vstack([np.zeros((2, 2)), x[:50] * 1.5])
    got, _, _ = pivots.pivot_neighbours(_frame(spark, q).select("id", "features"), _frame(spark, x), 7, False, 16, 300)
    assert _rows(got) == _brute(q, np.arange(52), x, np.arange(300), 7, False)


def test_far_from_the_origin(spark):
    x = _clustered(500, 5, dims=2, seed=5) + 1e5
    ids = np.arange(500)
    df = _frame(spark, x)
    got, _, _ = pivots.pivot_neighbours(df.select("id", "features"), df, 3, True, 32, 500)
    assert _rows(got) == _brute(x, ids, x, ids, 3, True)


def test_no_pruning_without_clusters_and_other_queries(spark):
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(400, 12)), rng.normal(size=(60, 12))
    got, _, _ = pivots.pivot_neighbours(_frame(spark, q).select("id", "features"), _frame(spark, x), 3, False, 40, 400)
    assert _rows(got) == _brute(q, np.arange(60), x, np.arange(400), 3, False)


def test_fewer_distinct_rows_than_neighbours(spark):
    x = np.zeros((50, 2))
    x[40:] = 1.0
    df = _frame(spark, x)
    got, _, _ = pivots.pivot_neighbours(df.select("id", "features"), df, 60, True, 8, 50)
    assert _rows(got) == _brute(x, np.arange(50), x, np.arange(50), 60, True)


def test_one_vector_only(spark):
    df = _frame(spark, np.ones((30, 3)))
    got, _, n_parts = pivots.pivot_neighbours(df.select("id", "features"), df, 2, True, 8, 30)
    assert n_parts == 1
    assert _rows(got) == _brute(np.ones((30, 3)), np.arange(30), np.ones((30, 3)), np.arange(30), 2, True)


@pytest.mark.parametrize("block_rows", [50, 5_000])
def test_both_paths_agree(spark, block_rows):
    x = _clustered(300, 4, seed=7)
    df = _frame(spark, x, label=np.arange(300) % 3)
    got = classify.knn_neighbours(df.select("id", "features"), df, 5, True, block_rows)
    assert _rows(got) == _brute(x, np.arange(300), x, np.arange(300), 5, True)


def test_empty_sides(spark):
    df = _frame(spark, _clustered(40, 2))
    none = df.where("id < 0")
    assert classify.knn_neighbours(df.select("id", "features"), none, 3).count() == 0
    assert classify.knn_neighbours(none.select("id", "features"), df, 3, block_rows=8).count() == 0


def test_blocks_grow_with_the_table_and_copies_do_not():
    from tabprobe.ml import pairwise
    copies = [pairwise.n_blocks(n, pairwise.grid_rows(n, 64)) for n in (50_000, 100_000, 500_000)]
    assert copies == [8, 8, 8] and pairwise.grid_rows(10**8, 64) * 64 == pairwise.BLOCK_CELLS
    left, right = np.array([5, 1, 9, 1]), np.array([1, 5, 1, 7])
    pairs = set(zip(*(p.tolist() for p in pairwise.equal_ids(left, right))))
    assert pairs == {(i, j) for i in range(4) for j in range(4) if left[i] == right[j]}


def test_a_query_travels_once_a_group(spark):
    """Queries that visit all partitions of a group are sent to it once and leave it with k rows."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8))
    df = _frame(spark, x)
    placed, parts = pivots.partition_reference(df, 300, 20)
    every = list(range(len(parts.cell)))
    q = df.select("id", "features").withColumn("_visit", F.array(*[F.lit(p) for p in every]))
    got = pivots._meet(q, placed, 3, True, 10**6, len(every))
    assert len(every) > 8 and got.count() == 300 * 3
    assert _rows(pivots.ranked(got, 3)) == _brute(x, np.arange(300), x, np.arange(300), 3, True)
