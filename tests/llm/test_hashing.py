"""Multi-index hashing: recall against brute force, retrieval of every code in the radius."""

import math

import numpy as np
import pyarrow as pa
import pytest

from tabprobe.llm import hashing as H
from tabprobe.llm.queries import op11


def fine(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, queries, k):
    c = sorted({(i, tuple(v)) for i, v in rows if i is not None and fine(v)})
    first = {}
    for i, v in c:
        if i in queries:
            first[i] = min(first.get(i, v), v)
    out = {}
    for q, qv in first.items():
        s = sorted(((-float(np.dot(np.array(qv), np.array(v))), i) for i, v in c if i != q and len(v) == len(qv)))[:k]
        out[q] = [(i, -x) for x, i in s]
    return out


def run(spark, rows, queries, k=10, kind="float", **kw):
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], f"vec_id long, v array<{kind}>, score int, j int, code string").repartition(4)
    q = df.where(df.vec_id.isin(list(queries))).select(df.vec_id.alias("query_id"), df.v.alias("qv"))
    out = {}
    for r in sorted(H.nearest(df, q, k, **kw).collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    hit = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hit / sum(len(w) for w in want.values())


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    got = {}
    for r in op11(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert all(len(got[q]) == 20 for q in want)
    assert recall(got, want) >= 0.9
    exact = {i: np.array(v) for i, v in rows}
    assert all(abs(s - float(exact[q] @ exact[i])) < 1e-12 for q, g in got.items() for i, s in g)


@pytest.mark.parametrize("page", [40, 8192])
def test_odd_vectors(spark, page):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(200)]
    rows += [(i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(400, 500)]  # a third of the rows are equal
    rows += [(700, None), (701, [1.0, None, 0.0]), (702, [float("nan")] * 6), (703, [float("inf")] + [0.0] * 5), (704, []), (705, [0.0] * 6),
             (None, [1.0] * 6), (706, [2.0, 1.0]), (707, [3.0, 1.0]), (5, [9.0] * 6), (5, [-9.0] * 6), (8, rows[8][1])]
    queries = {0, 5, 8, 100, 405, 499, 700, 702, 705, 706}
    got, want = run(spark, rows, queries, page_rows=page), brute(rows, queries, 10)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    assert [i for i, _ in got[405]] == [i for i, _ in want[405]] and [len(got[q]) for q in got] == [len(want[q]) for q in got]


def test_clusters_on_many_pages(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in centers[i % 40] * 3 + 0.3 * rng.normal(size=16)]) for i in range(3000)]
    queries = set(range(0, 3000, 60))
    got = run(spark, rows, queries, kind="double", page_rows=100)
    assert recall(got, brute(rows, queries, 10)) >= 0.9


def test_few_or_no_rows(spark):
    assert run(spark, [(1, [1.0]), (2, [2.0]), (3, [-1.0])], {1}) == {1: [(2, 2.0), (3, -1.0)]}
    assert run(spark, [(1, [1.0, 2.0])], {1}) == {} and run(spark, [(1, None)], {1}) == {} and run(spark, [(1, [1.0])], {2}) == {}


@pytest.mark.parametrize("radius", [0, 5, 17, 40, 64, 128])
def test_every_code_in_the_radius_is_retrieved_once(radius):
    """The pages of all indexes together give each entry in the radius exactly once."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 32, (20, H.PARTS), dtype=np.uint64).astype(np.uint32)
    code = base[rng.integers(0, 20, 400)]
    for bit in range(H.BITS):
        flip = rng.random(400) < 0.12
        code[flip, bit // 32] ^= np.uint32(1 << (bit % 32))
    vec = rng.normal(size=(400, 4))
    found = []
    for j in range(H.PARTS):
        page = H._Page(pa.table({"j": [j] * 400, "d": [4] * 400, "code": pa.array([c.tolist() for c in code.astype(np.int64)], pa.list_(pa.int64())),
                                 "vec": [v.tobytes() for v in vec], "ids": [[i] for i in range(400)]}), "<f8")
        ask = pa.RecordBatch.from_pydict({"rid": [9], "code": pa.array([base[0].astype(np.int64).tolist()], pa.list_(pa.int64())), "vec": [vec[0].tobytes()], "floor": pa.array([None], pa.float64())})
        for b in H._answer("<f8", radius, 400)(page, ask):
            found += b.column("vec_id").to_pylist()
    assert sorted(found) == np.flatnonzero(H.distance(code, base[0]) <= radius).tolist()
