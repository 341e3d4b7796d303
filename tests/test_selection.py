"""Splits cut by selected hashes, and ranks corrected for missing partners."""

import hashlib
import random

from pyspark.sql import functions as F

from tabprobe.ml import prepare
from tabprobe.operators import correlation


def split_by_hand(rows, share):
    out = set()
    by = {}
    for i, y in rows:
        by.setdefault(y, []).append((hashlib.md5(f"{i}-42".encode()).hexdigest(), i))
    for y, some in by.items():
        n = int(len(some) * share + 0.5)
        out |= {(i, y) for _, i in sorted(some)[:n]}
    return out


def test_cut_equals_a_sort(spark, monkeypatch):
    monkeypatch.setattr(prepare, "CUT_ROWS", 3)  # several refinements
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", None])) for i in range(4000)] + [(9001, "one"), (9002, "two"), (9003, "two")]
    df = spark.createDataFrame(rows, "id long, y string").repartition(5)
    for share in (0.0, 0.3, 0.5, 1.0):
        got = prepare.stratified_split(df, "y", ["id"], share)
        assert got.count() == len(rows)
        assert {(r["id"], r["y"]) for r in got.where("is_test").collect()} == split_by_hand(rows, share)


def test_split_shuffles_no_rows(spark):
    df = spark.range(50_000).select("id", (F.col("id") % 3).alias("y"), F.repeat(F.lit("x"), 50).alias("payload"))
    plan = prepare.stratified_split(df, "y", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_repeated_ids_straddle_the_cut(spark):
    df = spark.createDataFrame([(7, "a")] * 10 + [(8, "b")] * 4, "id long, y string")
    got = {(r["y"], r["is_test"]): r["n"] for r in prepare.stratified_split(df, "y", ["id"]).groupBy("y", "is_test").agg(F.count("*").alias("n")).collect()}
    assert got == {("a", True): 3, ("a", False): 7, ("b", True): 1, ("b", False): 3}


def test_spearman_with_many_gaps_equals_pandas(spark):
    rng = random.Random(2)
    cols = ["a", "b", "c", "d", "e", "k"]
    rows = [tuple(None if rng.random() < (0.0, 0.2, 0.5, 0.0, 0.9, 0.1)[j] else (4.0 if j == 5 else float(rng.randint(0, 12) + (i % 5) * (j % 3))) for j in range(6))
            for i in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(4)
    want = df.toPandas().corr(method="spearman")
    got = {(r["col_a"], r["col_b"]): r["r"] for r in correlation.corr_spearman(df).collect()}
    assert len(got) == 36
    for (a, b), r in got.items():
        w = want.loc[a, b]
        assert (r is None) == (w != w) and (r is None or abs(r - w) < 1e-9), (a, b, r, w)
