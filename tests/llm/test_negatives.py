"""Hard negatives against all pairs; the tree against plain scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprobe.llm import negatives as N


def brute(rows, anchors, pos=5, neg=10, low=30, high=90):
    clean = sorted({(i, lab, tuple(v)) for i, lab, v in rows if i is not None and lab is not None and v})
    out = []
    for a, alab, av in clean:
        if a not in anchors:
            continue
        s = sorted((-sum(x * y for x, y in zip(av, v)), i, lab) for i, lab, v in clean if i != a and len(v) == len(av))
        for ps, p in [(x, i) for x, i, lab in s if lab == alab][:pos]:
            hard = [(x, i) for x, i, lab in s if lab != alab and low * -ps <= 100 * -x <= high * -ps][:neg]
            out += [(a, p, r + 1, i, -ps, -x) for r, (x, i) in enumerate(hard)]
    return sorted(out)


def run(spark, rows, anchors, **kw):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, label int, v array<long>, score int, tile string, d int").repartition(3)
    got = N.hard_negatives(df, df.where(F.col("vec_id").isin(list(anchors))), **kw)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


def vectors(rng, n, d, clusters=5, noise=20):
    centers = rng.integers(-100, 100, (clusters, d))
    return [[int(x) for x in centers[i % clusters] + rng.integers(-noise, noise + 1, d)] for i in range(n)]


@pytest.mark.parametrize("tile", [30, N.TILE_ROWS])
def test_odd_rows(spark, tile, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 8)
    monkeypatch.setattr(N, "DIRECTORY", 3)
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 4)), v) for i, v in enumerate(vectors(rng, 200, 6))]
    rows += [(i, i % 2, [50, 10, 0, 0, 0, 0]) for i in range(300, 400)]  # a third of the rows are equal, under two labels
    rows += [(500, None, [1] * 6), (501, 1, None), (502, 1, []), (None, 1, [1] * 6), (503, 1, [3, 4]), (504, 1, [30, 4]), (505, 2, [10, 4]), (506, 7, [1, 2, 3]),
             (0, 3, [90] * 6), (1, *rows[1][1:]), (507, 9, [5] * 6), (508, 2, [0] * 6)]
    anchors = {0, 1, 10, 50, 100, 300, 301, 399, 500, 501, 503, 506, 507, 508}
    assert run(spark, rows, anchors, tile_rows=tile) == brute(rows, anchors)


def test_other_windows_and_counts(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, v) for i, v in enumerate(vectors(rng, 150, 4, 2, 60))]
    for kw in ({"positives": 2, "negatives": 30}, {"low": 0, "high": 100, "negatives": 3}):
        want = brute(rows, {0, 5, 9}, kw.get("positives", 5), kw.get("negatives", 10), kw.get("low", 30), kw.get("high", 90))
        assert run(spark, rows, {0, 5, 9}, tile_rows=40, **kw) == want


def test_no_rows_and_oversized(spark):
    assert run(spark, [], {1}) == [] and run(spark, [(1, 1, [1])], {1}) == [] and run(spark, [(1, 1, [1])], {2}) == []
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, 1, [4 << 40, 0]), (2, 1, [1 << 40, 1]), (3, 2, [1 << 40, 1])], {1})


@pytest.mark.parametrize("big", [False, True])
def test_tree_search_prunes_and_stays_exact(big, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 16)
    rng = np.random.default_rng(3)
    v = np.array(vectors(rng, 2000, 3, 8, 6), np.int64) * ((1 << 22) if big else 1)
    label = rng.integers(0, 5, 2000)
    tile = N.Tile(v, label, [[int(i)] for i in range(2000)]).opened()
    tree = tile.tree
    boxes = sum(c < 0 for c in tree.count)
    read = 0
    for a in range(0, 2000, 100):
        s = v @ v[a]
        best = sorted(((-int(s[i]), i) for i in range(2000) if label[i] == label[a]))[:6]
        win = N.Windows([-N._FAR], [N._FAR], [-N._FAR], 6)
        read += N.search(tile, v[a], int(label[a]), True, win)
        assert win.best[0] == best
        lows, highs = [-(-30 * -p // 100) for p, _ in best], [90 * -p // 100 for p, _ in best]
        win = N.Windows(lows, highs, lows, 10)
        read += N.search(tile, v[a], int(label[a]), False, win)
        for w, (lo, hi) in enumerate(zip(lows, highs)):
            assert win.best[w] == sorted(((-int(s[i]), i) for i in range(2000) if label[i] != label[a] and lo <= s[i] <= hi))[:10]
    assert read < 0.5 * 40 * boxes  # most leaves are pruned by their boxes


def test_boxes_bound_every_inner_product():
    rng = np.random.default_rng(4)
    for _ in range(50):
        v, q = rng.integers(-50, 50, (30, 5)), rng.integers(-50, 50, 5)
        least, most = N.interval(v.min(axis=0)[None], v.max(axis=0)[None], q)
        assert least[0] <= (v @ q).min() and (v @ q).max() <= most[0]
