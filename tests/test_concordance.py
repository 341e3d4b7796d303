"""Counts of tied and discordant pairs against brute force."""

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tabprobe.operators import concordance, correlation, ordering


def brute(x, y):
    ok = ~(np.isnan(x) | np.isnan(y))
    x, y = x[ok], y[ok]
    i, j = np.triu_indices(len(x), 1)
    with np.errstate(invalid="ignore"):
        sx, sy = (x[i] > x[j]) * 1 - (x[i] < x[j]), (y[i] > y[j]) * 1 - (y[i] < y[j])
    return [len(x), (sx == 0).sum(), (sy == 0).sum(), ((sx == 0) & (sy == 0)).sum(), (sx * sy < 0).sum()]


def test_inversions_equal_all_pairs():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 7, 64, 65, 200):
        y = rng.integers(0, max(1, n // 2) + 1, n)
        assert concordance.inversions(y) == sum(y[i] > y[j] for i in range(n) for j in range(i + 1, n))


def columns(n=700):
    rng = np.random.default_rng(1)
    heavy = np.where(rng.random(n) < 0.4, 5.0, rng.normal(5, 3, n))  # one value holds a third of the rows
    few = rng.integers(0, 3, n).astype(float)
    signs = np.where(rng.random(n) < 0.5, rng.choice([0.0, -0.0], n), rng.normal(0, 1, n))
    wild = np.where(rng.random(n) < 0.3, rng.choice([np.inf, -np.inf], n), heavy + rng.normal(0, 1, n))
    gaps = np.where(rng.random(n) < 0.2, np.nan, heavy * 2 + few)
    return {"heavy": heavy, "few": few, "signs": signs, "wild": wild, "gaps.x": gaps, "fine": rng.normal(0, 1, n), "same": np.ones(n)}


@pytest.mark.parametrize("rows_per_bucket", [10**9, 120, 20])
def test_counts_equal_brute_force(spark, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", rows_per_bucket)
    data = columns()
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*data.values())]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in data))
    pairs = list(combinations(range(len(data)), 2))
    got = {r["pair"]: r for r in concordance.pair_counts(df, list(data), pairs).collect()}
    values = list(data.values())
    for k, (i, j) in enumerate(pairs):
        assert [got[k][c] for c in ("n", "n1", "n2", "n3", "d")] == brute(values[i], values[j]), (i, j)


def test_no_rows_and_no_common_rows(spark):
    none = spark.createDataFrame([], "a double, b int")
    assert {r["r"] for r in correlation.corr_kendall(none).collect() if r["col_a"] != r["col_b"]} == {None}
    apart = spark.createDataFrame([(1.0, None), (None, 2.0)], "a double, b double")
    assert {r["r"] for r in correlation.corr_kendall(apart).collect() if r["col_a"] != r["col_b"]} == {None}


def test_rows_travel_at_most_twice_a_pair(spark):
    df = spark.range(1000).selectExpr("double(id) a", "double(id % 7) b", "1.0D c")
    plan = concordance.pair_counts(df, ["a", "b", "c"], [(0, 1), (0, 2), (1, 2)])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("FlatMapGroupsInPandas") == 2


@pytest.mark.parametrize("rows_per_bucket", [10**9, 20])
def test_ranks_of_value_ranges_equal_pandas(spark, monkeypatch, rows_per_bucket):
    """Columns of few values are not shuffled, the others once, and no column is joined by its values."""
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", rows_per_bucket)
    data = {c: np.clip(v, -1e300, 1e300) for c, v in columns().items() if c != "same"}  # pandas skips infinities
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*data.values())]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in data))
    got = {(r["col_a"], r["col_b"]): r["r"] for r in correlation.corr_spearman(df).collect()}
    want = df.toPandas().corr(method="spearman")
    assert all(abs(got[a, b] - want.loc[a, b]) < 1e-9 for a, b in combinations(data, 2))
    ranked, places = correlation.rank_vectors(df, list(data), ["gaps.x"])
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") <= len(data) and "Window" not in plan
    assert all(set(p) == {"gaps.x"} for p in places)


def test_rows_travel_once_a_column(spark):
    """The rows of a range bring all their values, so their number does not follow the number of pairs."""
    df = spark.range(4000).selectExpr("double(id) a", "double(id * 7919 % 4001) b", "double(id * 104729 % 4003) c", "double(id * 31 % 4007) d")
    pairs = list(combinations(range(4), 2))
    plan = concordance.pair_counts(df, list("abcd"), pairs)._jdf.queryExecution().optimizedPlan().toString()
    shipped = [line for line in plan.splitlines() if "Generate inline" in line and "range" in line]
    assert len(shipped) == 1 and plan.count("FlatMapGroupsInPandas") == 2
    got = concordance.pair_counts(df, list("abcd"), pairs).where("n <> 4000").count()
    assert got == 0


def test_inversions_of_many_ranks():
    rng = np.random.default_rng(2)
    for n, most in ((1000, 1000), (1500, 3), (1024, 1 << 40)):
        y = rng.integers(0, most, n)
        assert concordance.inversions(y) == int((y[:, None] > y[None, :])[np.triu_indices(n, 1)].sum())


def test_inversions_beyond_one_digit():
    """Sizes and ranks around the ends of the digits, against a merge count."""
    def merged(y):
        if len(y) < 2:
            return 0, y
        (a, x), (b, z) = merged(y[:len(y) // 2]), merged(y[len(y) // 2:])
        return a + b + int((len(x) - np.searchsorted(x, z, side="right")).sum()), np.sort(np.concatenate([x, z]))

    rng = np.random.default_rng(3)
    for n in (255, 256, 257, 511, 65_535, 65_536, 65_537, 140_000):
        for most in (2, 256, 257, 1 << 40):
            y = rng.integers(0, most, n)
            assert concordance.inversions(y) == merged(y)[0], (n, most)
        assert concordance.inversions(np.arange(n)[::-1]) == n * (n - 1) // 2


def test_rows_of_a_range_travel_in_blocks(spark, monkeypatch):
    """Spark shuffles and sorts a block a range and chunk, and the pairs' cells are counted before the shuffle."""
    rows = 4000
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 500)
    df = spark.range(0, rows, 1, 2).selectExpr("double(id) a", "double(id * 7919 % 4001) b", "double(id % 3) c")
    pairs = list(combinations(range(3), 2))
    plan = concordance.pair_counts(df, list("abc"), pairs)
    root, sent = plan._jdf.queryExecution().executedPlan(), []
    plan.collect()

    def walk(node):
        if node.nodeName() in ("AdaptiveSparkPlan",):
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        if node.nodeName() == "Exchange":
            sent.append(node.metrics().apply("shuffleRecordsWritten").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
    walk(root)
    assert sent and max(sent) < rows


@pytest.mark.parametrize("cells", [7, 1 << 20])
def test_counts_of_any_chunk(spark, monkeypatch, cells):
    """Chunks of a few rows and of whole tasks give the same blocks and cells in sum."""
    ranges = [([-np.inf, 2.0, np.nextafter(2.0, 3), np.inf], [1]), ([-np.inf, 0.0, np.inf], [])]
    a = np.array([np.nan, 2, 2, -np.inf, np.inf, 1, 3, 2])
    b = np.array([1, np.nan, -1, -0.5, 0, 7, np.inf, 2])
    monkeypatch.setattr(concordance, "CHUNK_CELLS", cells)
    batches = [pa.RecordBatch.from_arrays([pa.array(v[s:s + 3], from_pandas=True) for v in (a, b)], ["v0", "v1"]) for s in (0, 3, 6)]
    empty = batches[0].slice(0, 0)
    count = Counter()
    for c in concordance._cells_of(iter([empty, *batches]), 2, [(0, 1)], ranges):
        for r in c.to_pylist():
            count[r["bx"], r["by"]] += r["n"]
    assert count == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 1, (2, 1): 2}
    blocks = {}
    for c in concordance._blocks_of(iter([*batches, empty]), 2, ranges):
        for r in c.to_pylist():
            for g in r["ranges"]:
                rows = np.frombuffer(g["rows"], np.float64).reshape(2, -1).T.tolist()
                blocks.setdefault((r["col"], g["range"]), []).extend(tuple(map(str, v)) for v in rows)
    want = {(0, 0): [3, 5], (0, 2): [4, 6], (1, 0): [2, 3], (1, 1): [0, 4, 5, 6, 7]}
    assert {k: sorted(v) for k, v in blocks.items()} == {k: sorted((str(a[i]), str(b[i])) for i in v) for k, v in want.items()}
    assert not list(concordance._cells_of(iter([empty]), 2, [(0, 1)], ranges))
