import random

import numpy as np
import pytest

from tabprobe.llm import quality as Q


def test_label_model_finds_kinds_without_labels():
    rng = np.random.default_rng(1)
    k = len(Q.LABELLERS)
    good = rng.random(5000) < 0.85
    kind = rng.integers(0, 3, 5000)
    votes = np.where(rng.random((5000, k)) < 0.2, 1, 2)
    for x in range(3):
        votes[:, x] = np.where(~good & (kind == x) & (rng.random(5000) < 0.95) | (rng.random(5000) < 0.002), 0, votes[:, x])
    codes, inv, counts = np.unique((votes * 3 ** np.arange(k)).sum(axis=1), return_inverse=True, return_counts=True)
    post, rates, share = Q.label_model(codes, counts.astype(float))
    assert np.mean((post[inv] >= 0.5) == good) > 0.98
    assert abs(share[-1] - good.mean()) < 0.06 and all(rates[x, x] > 0.8 for x in range(3))


def test_odd_rows_and_empty(spark, odd, empty):
    out = Q.judge(odd).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    for r in out:
        if r["doc_id"] in (3, 4, 5):
            assert r["score"] == 0 and not r["keep"]
    kept = Q.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["keep"] for r in out)
    assert Q.judge(empty).collect() == [] and Q.keep_good(empty).collect() == []
    assert Q.judge(odd.where("doc_id IN (3, 4, 5)")).where("keep").count() == 0


def test_repeated_rows_get_one_score(spark):
    rng = random.Random(1)
    base = " ".join("".join(rng.choices("abcdeio", k=5)) for _ in range(50)) + "."
    df = spark.createDataFrame([(i, base) for i in range(50)] + [(99, "### @@@ " * 20)], "doc_id long, text string")
    assert len({(r["doc_id"] < 99, r["score"]) for r in Q.judge(df).collect()}) == 2


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_agrees_with_labels_it_never_reads(spark, sf):
    import __spark_entry__ as E
    sf = f"/root/testdata/{sf}"
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = {r["doc_id"]: r for r in E.queries()["op10_quality_classifier"](spark, sf).collect()}
    good = [rows[i]["keep"] for i, q in quality.items() if q]
    bad = [rows[i]["keep"] for i, q in quality.items() if not q]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.15
