import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprobe.llm import topk as T


def brute(rows, queries, k):
    q8 = lambda v: None if v is None or any(x is None or not math.isfinite(x) for x in v) or not v else [math.floor(1024 * float(np.float32(x))) for x in v]
    c = [(i, q8(v)) for i, v in rows]
    c = [(i, v) for i, v in c if i is not None and v]
    firsts = {}
    for i, v in c:
        if i in queries:
            firsts[i] = min(firsts.get(i, v), v)
    out = []
    for q, qv in firsts.items():
        s = sorted(((-sum(a * b for a, b in zip(qv, v)), i) for i, v in c if i != q and len(v) == len(qv)))[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def run(spark, rows, queries, k=10):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, v string").repartition(3)
    v = df.select("vec_id", T.quantized(F.col("embedding")).alias("v"))
    out = T.top_k(v, v.where(F.col("vec_id").isin(list(queries))).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), k)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect())


def test_exact_with_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(400, 600)]  # a very common vector
    rows += [(700, None), (701, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (702, [float("nan")] * 6), (703, [float("inf")] + [0.0] * 5), (704, []),
             (None, [1.0] * 6), (705, [2.0, 1.0]), (706, [3.0, 1.0]), (5, [9.0] * 6), (5, [-9.0] * 6), (8, rows[8][1])]
    queries = {0, 5, 8, 100, 405, 700, 702, 705}
    assert run(spark, rows, queries) == brute(rows, queries, 10)


def test_small_trees_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "TREE_ROWS", 64)
    monkeypatch.setattr(T, "QUERY_ROWS", 4)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(5, 8))
    rows = [(i, [float(x) for x in centers[i % 5] + 0.1 * rng.normal(size=8)]) for i in range(500)]
    queries = set(range(0, 500, 25))
    assert run(spark, rows, queries, 7) == brute(rows, queries, 7)


def test_few_or_no_candidates(spark):
    assert run(spark, [(1, [1.0]), (2, [2.0]), (3, [-1.0])], {1}) == [(1, 1, 2, 2048 * 1024), (1, 2, 3, -1024 * 1024)]
    df = spark.createDataFrame([], "vec_id long, embedding array<float>").select("vec_id", T.quantized(F.col("embedding")).alias("v"))
    assert T.top_k(df, df.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))).collect() == []


@pytest.mark.parametrize("shape", ["normal", "clusters", "equal"])
def test_search_prunes_and_stays_exact(shape, monkeypatch):
    monkeypatch.setattr(T, "PAGE", 20)
    rng = np.random.default_rng(5)
    n = 900
    v = {"normal": rng.normal(size=(n, 12)), "clusters": rng.normal(size=(6, 12))[np.arange(n) % 6] + 0.05 * rng.normal(size=(n, 12)),
         "equal": np.ones((n, 12))}[shape]
    whole = np.floor(1024 * v).astype(np.int64)
    ids = rng.permutation(n).astype(np.int64)
    tree = T.build(whole.astype(float), ids)
    for j in range(0, n, 90):
        s = whole @ whole[j]
        best = sorted(((-int(x), int(i)) for x, i in zip(s, ids) if i != ids[j]))[:10]
        m = T.exact_matrix(whole)
        assert T.search(tree, m, ids, m[j], int(ids[j]), 10) == [(-x, i) for x, i in best]
