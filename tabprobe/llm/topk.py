"""Exact top-k by inner product with M-trees and best-first search.

Vectors are dealt over trees of at most ``TREE_ROWS`` rows. A tree's pages hold a
routing vector, the covering radius, the distance to the parent's routing
vector, the largest norm and the smallest id below. For a query ``q`` and a
page with routing vector ``c`` and radius ``r``, every inner product below is
at most ``<q, c> + |q| r`` and at most ``(|q|^2 + R^2 - max(0, d(q, c) - r)^2) / 2``
(``R``: largest norm). Pages are visited in the order of that bound until it
falls below the k-th score. Before a distance is computed, the stored parent
distance gives ``d(q, c) >= |d(q, p) - d(p, c)|``, which often settles the page
or the row without it. Components are integers, so scores are exact and a
bound can be rounded down to one.

Scale: each (tree, block of ``QUERY_ROWS`` queries) is one bounded task; a task
returns at most k rows a query, and a window keeps the k best of all trees.

Defined results: vectors that are null or hold null or non-finite components,
and rows without an id, take no part; vectors are only compared with vectors of
their own length; rows with the query's id are not its candidates; repeated
rows are candidates each, a repeated query id is searched once (its smallest
vector); ties go to the smaller id; fewer than k candidates give all of them;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREE_ROWS = 8192
QUERY_ROWS = 4096
PAGE = 512
FAN = 16


class Page:
    """A node: its routing vector, radius and members or children."""

    __slots__ = ("center", "radius", "to_parent", "norm", "low", "rows", "row_dist", "children", "c", "r", "p", "n", "l")

    def __init__(self, center, radius, to_parent, norm, low):
        self.center, self.radius, self.to_parent, self.norm, self.low = center, radius, to_parent, norm, low
        self.rows = self.row_dist = self.children = None


def build(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None, parent: np.ndarray | None = None, depth: int = 0) -> Page:
    """A tree over ``vectors[rows]``; pages split around spread-out routing vectors."""
    rows = np.argsort(ids, kind="stable") if rows is None else rows
    v = vectors[rows]
    mean = v.mean(axis=0)
    center = v[np.argmin(((v - mean) ** 2).sum(axis=1))]
    dist = np.sqrt(((v - center) ** 2).sum(axis=1))
    page = Page(center, dist.max(), 0.0 if parent is None else float(np.sqrt(((center - parent) ** 2).sum())),
                np.sqrt((v * v).sum(axis=1).max()), int(ids[rows].min()))
    if len(rows) <= PAGE:
        page.rows, page.row_dist = rows, dist
        return page
    if dist.max() == 0 or depth > 40:  # equal vectors: pages in id order
        parts = [rows[i:i + PAGE] for i in range(0, len(rows), PAGE)]
        if len(parts) > FAN:
            step = -(-len(parts) // FAN)
            parts = [np.concatenate(parts[i:i + step]) for i in range(0, len(parts), step)]
    else:
        far = [int(np.argmax(dist))]  # farthest-first routing vectors
        near = np.sqrt(((v - v[far[0]]) ** 2).sum(axis=1))
        who = np.zeros(len(rows), np.int64)
        fan = min(FAN, max(2, -(-2 * len(rows) // PAGE)))
        while len(far) < fan and near.max() > 0:
            far.append(int(np.argmax(near)))
            d = np.sqrt(((v - v[far[-1]]) ** 2).sum(axis=1))
            closer = d < near
            who[closer] = len(far) - 1
            near[closer] = d[closer]
        parts = [rows[who == k] for k in range(len(far)) if (who == k).any()]
    page.children = [build(vectors, ids, part, center, depth + 1) for part in parts]
    ch = page.children
    page.c = np.stack([x.center for x in ch])
    page.r, page.p = np.array([x.radius for x in ch]), np.array([x.to_parent for x in ch])
    page.n, page.l = np.array([x.norm for x in ch]), np.array([x.low for x in ch])
    return page


def exact_matrix(whole: np.ndarray) -> np.ndarray:
    """The matrix to take inner products with: doubles while these are exact
    (below 2**53), else the integers themselves."""
    top = float(np.abs(whole).max(initial=0))
    return whole.astype(np.float64) if top * top * whole.shape[1] < 2.0 ** 52 else whole


def search(tree: Page, whole: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int):
    """[(score, id)] of the k best rows of a tree. ``whole``: the vectors as
    ``exact_matrix`` gives them; ``query`` alike."""
    q = query.astype(np.float64)
    qq = float(q @ q)
    qn = np.sqrt(qq)
    best: list[tuple[int, int]] = []  # heap of (score, -id)
    floor = None

    def bounds(dist, radius, norm):
        return (qq + norm * norm - np.maximum(0, dist - radius) ** 2) / 2

    def whole_bound(x):
        return np.floor(x + 1e-6 * (1 + np.abs(x)))

    d0 = float(np.sqrt(((tree.center - q) ** 2).sum()))
    queue = [(-np.inf, 0, 0, tree, d0)]
    count = 1
    while queue:
        neg, _, _, page, d = heapq.heappop(queue)
        if floor is not None and (-neg, -page.low) < floor:
            if -neg < floor[0]:
                break
            continue
        if page.rows is not None:
            # rows that the parent distance settles are not computed
            rows = page.rows
            if floor is not None:
                ub = whole_bound((qq + page.norm ** 2 - np.maximum(0, np.abs(d - page.row_dist) - 1e-6) ** 2) / 2)
                rows = rows[ub >= floor[0]]
            found, names = whole[rows] @ query, ids[rows]
            ok = names != own
            if floor is not None:
                ok &= found >= floor[0]
            found, names = found[ok], names[ok]
            if len(found) > k:  # only the page's own k best can matter
                top = np.lexsort((names, -found))[:k]
                found, names = found[top], names[top]
            for s, i in zip(found.tolist(), names.tolist()):
                if len(best) < k:
                    heapq.heappush(best, (int(s), -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (int(s), -i))
            if len(best) == k:
                floor = best[0]
            continue
        least = np.abs(d - page.p) - 1e-6  # lower bound of the children's distances
        ub = whole_bound(bounds(least, page.r, page.n))
        at = np.arange(len(ub)) if floor is None else np.flatnonzero((ub > floor[0]) | ((ub == floor[0]) & (-page.l > floor[1])))
        if not len(at):
            continue
        dist = np.sqrt(((page.c[at] - q) ** 2).sum(axis=1))
        ub = np.minimum(bounds(dist - 1e-6, page.r[at], page.n[at]), page.c[at] @ q + qn * page.r[at])
        for j, u, x in zip(at.tolist(), whole_bound(ub).tolist(), dist.tolist()):
            if floor is None or (u, -page.children[j].low) > floor:
                heapq.heappush(queue, (-u, page.children[j].low, count, page.children[j], x))
                count += 1
    return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def quantized(vector: Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` per component; null where a component is null or not finite."""
    v = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(good, F.transform(v, lambda x: F.floor(x * scale).cast("long")))


def _block_task(k):
    def run(left, right):
        import pandas as pd
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        whole = np.stack(left["v"].to_numpy()).astype(np.int64)
        ids = left["vec_id"].to_numpy()
        tree = build(whole.astype(np.float64), ids)
        queries = np.stack(right["qv"].to_numpy()).astype(np.int64)
        both = exact_matrix(np.concatenate([whole, queries]))  # one kind of numbers for both sides
        whole, queries = both[:len(whole)], both[len(whole):]
        out = []
        for qid, q in zip(right["query_id"].tolist(), queries):
            out += [(qid, i, s) for s, i in search(tree, whole, ids, q, qid, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")
    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score. ``candidates``: vec_id, v (array<bigint>);
    ``queries``: query_id, qv."""
    c = candidates.where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").select(F.col("vec_id").cast("long"), "v")
    q = (queries.where("query_id IS NOT NULL AND qv IS NOT NULL AND size(qv) > 0")
                .groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.min("qv").alias("qv")))
    trees = max(1, -(-c.count() // (TREE_ROWS * 3 // 4)))
    blocks = max(1, -(-q.count() // QUERY_ROWS))
    deal = lambda col, n, seed: F.pmod(F.xxhash64(*col, F.lit(seed)), F.lit(n))
    left = c.withColumns({"t": deal(["vec_id", "v"], trees, 1), "b": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))),
                          "d": F.size("v")})
    right = q.withColumns({"b": deal(["query_id"], blocks, 2), "t": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long"))),
                           "d": F.size("qv")})
    found = (left.groupBy("t", "b", "d").cogroup(right.groupBy("t", "b", "d"))
                 .applyInPandas(_block_task(k), "query_id long, vec_id long, score long"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
