"""Concordance counts for Kendall's tau-b by a grid of value ranges.

Every column is cut into ranges of about equal row counts (splits from one bounded sample
of the rows); a value that fills several ranges gets a range of its own.
The range of a cell is a function of its value, so nothing is joined or written.
For a pair of columns, two rows are then compared in exactly one place:

* both columns in different ranges: the pair's matrix of row counts, range by
  range, decides with two-dimensional running sums; a task counts its rows before they are shuffled;
* first column in one range: inversions inside that range;
* only the second column in one range: inversions between the first column's
  range numbers and the values.

A range of a single value holds ties only and ships no rows. A row travels at most once for each
column, with all its values, and its range's task counts all pairs of that column. The rows of a chunk that
go to the same range travel as one block of doubles, so Spark moves and sorts blocks, not rows.

Scale: a group holds about ``rows / ranges`` rows (8 bytes a column each), with at most
``MAX_RANGES`` ranges, so groups grow beyond some 10^7 rows above 10^10 rows; a
pair's matrix has at most ``(2 * MAX_RANGES) ** 2`` counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.functions.columns import qcol
from tabprobe.operators.ordering import bucket_count

MAX_RANGES = 1024
SAMPLE_PER_RANGE = 64
SAMPLE_SEED = 7
ROWS_PER_TASK = 50_000  # rows of the table a task that compares rows; fewer are not worth a Python worker
CHUNK_CELLS = 1 << 19  # values that a task holds of its rows at once: 4 MB, and as much again while they are dealt
DIGIT_BITS = 8
DIGIT = 1 << DIGIT_BITS
BLOCKS = 1024  # compared at once: a quarter MB of digits
LOW = (1 << 32) - 1
COUNTS = "pair int, n double, n1 double, n2 double, n3 double, d double"


def inversions(y: np.ndarray) -> int:
    """Positions i < j with y[i] > y[j]."""
    return _inversions(_ranks(y))


def _ranks(v: np.ndarray) -> np.ndarray:
    """Each value's place among the different values, from 0."""
    order = np.argsort(v)
    v = np.take(v, order)
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    ranks = np.empty(len(v), np.int64)
    ranks[order] = np.cumsum(new) - 1
    return ranks


def _inversions(ranks: np.ndarray) -> int:
    """Inversions of ranks below 2^32. Up to ``DIGIT`` different ranks are one digit, counted as they stand. More have
    as many inversions as the positions in order of rank (equal ranks by position).

    Positions are all different, so those that agree in their higher digits fill a segment of known length. From
    the highest digit down, the pairs of a segment that differ first in this digit are counted, then the
    segments of the next digit are formed, each still in order of rank."""
    n = len(ranks)
    if n < 2:
        return 0
    filled = -(-n // DIGIT) * DIGIT
    if ranks.max() < DIGIT:
        digit = np.full(filled, DIGIT - 1, np.uint8)  # filled up by ranks that none exceeds
        digit[:n] = ranks
        return _inside_blocks(digit) + _across_blocks(digit, filled)
    p = np.arange(filled)  # filled up by positions that stand last, in order
    p[:n] = np.sort(ranks << 32 | p[:n]) & LOW
    shift = 0
    while n > DIGIT << shift:
        shift += DIGIT_BITS
    total = 0
    while True:
        digit = (p >> shift).astype(np.uint8)  # the lowest eight bits
        total += _inside_blocks(digit)
        if not shift:
            return total
        total += _across_blocks(digit, 1 << shift)
        higher = p >> shift
        p = p[np.argsort(higher.astype(np.uint16) if higher.max() < 1 << 16 else higher, kind="stable")]
        shift -= DIGIT_BITS


def _inside_blocks(digit: np.ndarray) -> int:
    """Inversions inside each ``DIGIT`` neighbours: every distance compares all blocks at once."""
    blocks, total = digit.reshape(-1, DIGIT), 0
    for start in range(0, len(blocks), BLOCKS):
        t = np.ascontiguousarray(blocks[start:start + BLOCKS].T)
        out = np.empty(t.shape, bool)
        for k in range(1, DIGIT):
            total += int(np.count_nonzero(np.greater(t[:-k], t[k:], out=out[k:])))
    return total


def _across_blocks(digit: np.ndarray, segment: int) -> int:
    """Inversions between different blocks of ``DIGIT`` neighbours in the same segment of ``segment`` blocks."""
    total = 0
    for start in range(0, len(digit), segment * DIGIT):
        mine = digit[start:start + segment * DIGIT]
        size, digits = len(mine) // DIGIT, int(mine.max()) + 1
        at = np.repeat(np.arange(0, size * digits, digits), DIGIT) + mine
        count = np.bincount(at, minlength=size * digits).reshape(size, digits)
        before = np.cumsum(count, axis=0) - count
        smaller = np.cumsum(count, axis=1) - count  # of the same block
        total += int((before * smaller).sum())
    return total


def _tied(counts: np.ndarray) -> float:
    """Pairs of rows out of the same count."""
    c = counts.astype(np.float64)
    return float((c * (c - 1) / 2).sum())


def _ties(sorted_keys: np.ndarray) -> float:
    """Pairs of rows equal in their keys; equal keys stand together."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return _tied(np.diff(np.append(np.flatnonzero(new), len(sorted_keys))))


def _inside(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float, float]:
    """n1, n2, n3, d of the rows of one range of the first column (a, b: ranks of both values)."""
    both = np.sort(a << 32 | b)
    return _tied(np.bincount(a)), 0.0, _ties(both), float(_inversions(both & LOW))


def _beside(bx: np.ndarray, y: np.ndarray, single: np.ndarray) -> tuple[float, float, float, float]:
    """The same of one range of the second column (bx: the first column's ranges, y: ranks). Rows whose first
    column has its range to itself (``single``) do not travel by it, so their ties in both columns count here."""
    held = np.flatnonzero(np.bincount(bx))
    place = np.zeros(held[-1] + 1, np.int64)
    place[held] = np.arange(len(held))
    both = np.sort(y << 32 | place[bx])
    place = both & LOW
    return 0.0, _tied(np.bincount(y)), _ties(both[single[held][place]]), float(_inversions(place))


def _between(cells: pd.DataFrame, ranges, pairs) -> pd.DataFrame:
    """Counts that the matrix of one pair decides."""
    pair = int(cells["pair"].iloc[0])
    bx, by = cells["bx"].to_numpy(np.int64), cells["by"].to_numpy(np.int64)
    m = np.zeros((bx.max() + 1, by.max() + 1))
    m[bx, by] = cells["n"]
    sx, sy = (np.isin(np.arange(size), ranges[c][1]) for size, c in zip(m.shape, pairs[pair]))
    later = np.cumsum(m[::-1], axis=0)[::-1] - m  # rows in later ranges of x, the same range of y
    d = (m * (np.cumsum(later, axis=1) - later)).sum()
    return pd.DataFrame({"pair": [pair], "n": [m.sum()], "n1": [_tied(m.sum(axis=1)[sx])],
                         "n2": [_tied(m.sum(axis=0)[sy])], "n3": [_tied(m[np.ix_(sx, sy)])], "d": [d]})


def value_ranges(wide: DataFrame, cols: Sequence[str], n: int) -> list[tuple[list[float], list[int]]]:
    """Per column: the splits of about ``n`` ranges [s0, s1), [s1, s2), ... and the ranges of a single value.
    The splits come from one bounded sample of the rows; they decide how even the ranges are, and no result."""
    n = min(MAX_RANGES, n)
    rows = wide.count() if n > 1 else 0
    sample = wide.select(*[qcol(c) for c in cols]).sample(min(1.0, n * SAMPLE_PER_RANGE / max(rows, 1)), SAMPLE_SEED).toPandas() if n > 1 else None
    out = []
    for k in range(len(cols)):
        found = np.zeros(0) if sample is None else sample.iloc[:, k].to_numpy(float, na_value=np.nan) + 0.0  # -0.0 is 0.0
        found = np.sort(found[~np.isnan(found)])
        found = found[[len(found) * i // n for i in range(1, n)]] if len(found) else found
        found = found[np.isfinite(found)]
        values, times = np.unique(found, return_counts=True)
        heavy = values[times > 1]
        splits = np.unique(np.concatenate([values, np.nextafter(heavy, math.inf)]))
        splits = splits[np.isfinite(splits)] if len(splits) else np.zeros(1)
        splits = [-math.inf, *splits.tolist(), math.inf]
        out.append((splits, [splits.index(v) for v in heavy.tolist() if np.nextafter(v, math.inf) < math.inf]))
    return out


def in_ranges(df: DataFrame, splits: dict[str, list[float]], names: Sequence[str]) -> DataFrame:
    """Append, under ``names``, the number of the range that holds each column's value (null: null)."""
    cut = Bucketizer(splitsArray=list(splits.values()), inputCols=list(splits), outputCols=list(names), handleInvalid="keep").transform(df)
    return cut.withColumns({b: F.when(F.col(c).isNotNull(), F.col(b).cast("int")) for c, b in zip(splits, names)})


def _range_of(values: np.ndarray, splits: Sequence[float]) -> np.ndarray:
    """``in_ranges`` of present values in a task: the number of each value's range."""
    return np.minimum(np.searchsorted(splits, values, side="right") - 1, len(splits) - 2)  # infinity is in the last range


def _chunks(batches: Iterator[pa.RecordBatch], cols: int) -> Iterator[np.ndarray]:
    """The rows of a task as matrices of a row a column and at most some ``CHUNK_CELLS`` values (missing: NaN)."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            rows += batch.num_rows
        if rows * cols >= CHUNK_CELLS:
            yield np.concatenate(held, axis=1)
            held, rows = [], 0
    if held:
        yield np.concatenate(held, axis=1)


def _cells_of(batches: Iterator[pa.RecordBatch], cols: int, pairs, ranges) -> Iterator[pa.RecordBatch]:
    """Rows of each pair of ranges in a chunk."""
    for chunk in _chunks(batches, cols):
        # missing values take the number after the last range
        at = [np.where(np.isnan(v), len(splits) - 1, _range_of(v, splits)) for v, (splits, _) in zip(chunk, ranges)]
        for p, (i, j) in enumerate(pairs):
            none_i, none_j = len(ranges[i][0]) - 1, len(ranges[j][0]) - 1
            cell = at[i] * (none_j + 1) + at[j]
            if len(cell) >= (none_i + 1) * (none_j + 1):
                n = np.bincount(cell)
                cell = np.flatnonzero(n)
                n = n[cell]
            else:
                cell, n = np.unique(cell, return_counts=True)
            bx, by = np.divmod(cell, none_j + 1)
            both = (bx < none_i) & (by < none_j)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(both.sum(), p, np.int32)), pa.array(bx[both].astype(np.int32)),
                                              pa.array(by[both].astype(np.int32)), pa.array(n[both].astype(np.int64))], ["pair", "bx", "by", "n"])


def _blocks_of(batches: Iterator[pa.RecordBatch], cols: int, ranges) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk dealt by each column's ranges of several values: per range one block of doubles, column by column."""
    kind = pa.list_(pa.struct([("range", pa.int32()), ("rows", pa.binary())]))
    for chunk in _chunks(batches, cols):
        for k, (splits, single) in enumerate(ranges):
            there = np.flatnonzero(~np.isnan(chunk[k]))
            order = np.take(there, np.argsort(np.take(chunk[k], there)))
            bounds = np.searchsorted(np.take(chunk[k], order), splits[1:-1])
            bounds = np.concatenate([[0], bounds, [len(order)]])
            held = np.setdiff1d(np.flatnonzero(np.diff(bounds)), single)
            if len(held):
                dealt = np.take(chunk, order, axis=1)
                groups = [{"range": b, "rows": dealt[:, bounds[b]:bounds[b + 1]].tobytes()} for b in held.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([groups], kind)], ["col", "ranges"])


def _inside_range(blocks: pd.DataFrame, cols: int, pairs, ranges) -> pd.DataFrame:
    """Counts of all pairs with the column whose range the rows share (``col``, ``range``)."""
    k, out = int(blocks["col"].iloc[0]), []
    values = np.concatenate([np.frombuffer(b, np.float64).reshape(cols, -1) for b in blocks["rows"]], axis=1)
    mine = _ranks(values[k])
    for p, (i, j) in enumerate(pairs):
        if k not in (i, j):
            continue
        other = j if k == i else i
        there = ~np.isnan(values[other])
        if not there.any():
            continue
        theirs = values[other][there]
        if k == i:
            out.append((p, *_inside(mine[there], _ranks(theirs))))
        else:
            splits, single = ranges[other]
            out.append((p, *_beside(_range_of(theirs, splits), mine[there], np.isin(np.arange(len(splits)), single))))
    n1, n2, n3, d = (np.array([o[1 + f] for o in out], float) for f in range(4))
    return pd.DataFrame({"pair": np.array([o[0] for o in out], np.int32), "n": np.zeros(len(out)), "n1": n1, "n2": n2, "n3": n3, "d": d})


def pair_counts(wide: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """For every pair (numbered as listed) over its complete rows: ``n`` rows, ``n1`` /
    ``n2`` / ``n3`` pairs of rows tied in the first / second / both columns, ``d``
    discordant pairs. ``wide``: doubles without NaN. Pairs without rows are absent."""
    names = [f"v{k}" for k in range(len(cols))]
    plain = wide.select(*[(qcol(c) + F.lit(0.0)).alias(v) for c, v in zip(cols, names)])
    rows = wide.count()
    n = bucket_count(wide, rows)
    ranges, tasks = value_ranges(plain, names, n), max(1, min(n, rows // ROWS_PER_TASK))
    pairs, n_cols = list(pairs), len(cols)
    cells = plain.mapInArrow(lambda batches: _cells_of(batches, n_cols, pairs, ranges), "pair int, bx int, by int, n long")
    cells = cells.groupBy("pair", "bx", "by").agg(F.sum("n").alias("n"))
    blocks = plain.mapInArrow(lambda batches: _blocks_of(batches, n_cols, ranges), "col int, ranges array<struct<range int, rows binary>>")
    blocks = blocks.select("col", F.inline("ranges")).repartition(tasks, "col", "range")  # by work: blocks compress well
    inside = blocks.groupBy("col", "range").applyInPandas(lambda b: _inside_range(b, n_cols, pairs, ranges), COUNTS)
    between = cells.groupBy("pair").applyInPandas(lambda c: _between(c, ranges, pairs), COUNTS)
    return inside.unionByName(between).groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("n", "n1", "n2", "n3", "d")])
