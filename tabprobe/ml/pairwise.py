"""Exact all-pairs work without a cross join.

Some measures need every (query, reference) pair: exact k nearest neighbours
and the exact silhouette. Instead of emitting pair rows, both sides are cut
into blocks of bounded size; each query block meets each reference block in
one ``cogroup`` group, where NumPy computes the distances in memory and emits
only a bounded reduction (k neighbours, or one partial sum per cluster). The
work is the inherent n x m of the exact measure, spread over
``query_blocks x ref_blocks`` tasks, each holding two bounded blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BLOCK_ROWS = 4_096
MIN_BLOCK_ROWS = 64
GRID = 8  # blocks a side: every row is copied that often, until a block has BLOCK_CELLS values
BLOCK_CELLS = 1 << 22  # 32 MB
TILE_CELLS = 1 << 22  # distances held at a time


def grid_rows(n_rows: int, dims: int, least: int = DEFAULT_BLOCK_ROWS) -> int:
    """Rows of a block: blocks grow with the table, so that copies do not, up to ``BLOCK_CELLS`` values (65,536 rows of
    64). Beyond ``GRID`` such blocks the copies grow with the table, as all pairs must meet."""
    return max(least, min(math.ceil(n_rows / GRID), BLOCK_CELLS // max(dims, 1)))


def n_blocks(n_rows: int, block_rows: int, spread: int = 1) -> int:
    """Blocks of at most ``block_rows`` rows, and at least ``spread`` when there
    are rows for them."""
    return max(1, math.ceil(n_rows / block_rows), min(spread, n_rows // MIN_BLOCK_ROWS))


def blocked(query: DataFrame, ref: DataFrame, fn, schema: str,
            query_rows: int, ref_rows: int, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Apply ``fn(query_pdf, ref_pdf) -> pdf`` to every (query block, ref block).

    ``query`` and ``ref`` must carry an ``id`` column; blocks are hash
    buckets of it, so their sizes are balanced whatever the key distribution.
    """
    cores = query.sparkSession.sparkContext.defaultParallelism
    # the query side is cut further, so every core gets a meeting
    rb = n_blocks(ref_rows, block_rows)
    qb = n_blocks(query_rows, block_rows, math.ceil(2 * cores / rb))
    # fresh attributes on both sides: the two inputs are often the same table
    query = query.select(*[F.col(c).alias(c) for c in query.columns])
    ref = ref.select(*[F.col(c).alias(c) for c in ref.columns])
    q = query.select("*", F.pmod(F.xxhash64("id"), F.lit(qb)).alias("_qb"),
                     F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("_rb"))
    r = ref.select("*", F.pmod(F.xxhash64("id"), F.lit(rb)).alias("_rb"),
                   F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("_qb"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({f.split()[0]: [] for f in schema.split(",")})
        return fn(left, right)

    return q.groupBy("_qb", "_rb").cogroup(r.groupBy("_qb", "_rb")).applyInPandas(run, schema)


def matrix(series: pd.Series) -> np.ndarray:
    """Stack an array column into a float64 matrix."""
    return np.vstack([np.asarray(v, dtype=np.float64) for v in series])


def sq_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.maximum(d, 0.0)


def equal_ids(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in ``left``, positions in ``right``) of all pairs with one id."""
    order = np.argsort(right, kind="stable")
    held = right[order]
    lo, hi = np.searchsorted(held, left), np.searchsorted(held, left, side="right")
    n = hi - lo
    start = np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.arange(len(left)), n), order[np.repeat(lo, n) + np.arange(n.sum()) - start]
