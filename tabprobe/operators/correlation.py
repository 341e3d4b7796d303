"""Pairwise-complete correlation matrices (S3-S6, V9) in long form
``(col_a, col_b, r)``.

* Pearson: one pass for null-free columns, one ``corr`` aggregate per batch of the other pairs.
* Spearman: Pearson on average ranks. Each column is ranked once by running counts inside
  value ranges; where a partner has missing values, the rows without it are subtracted from the rank.
* Kendall tau-b: no self-join. Pairs of rows are counted by a grid of value ranges
  and by merging inside the ranges (``concordance``).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.functions.columns import clean_numeric, numeric_columns, qcol
from tabprobe.operators.concordance import in_ranges, pair_counts, value_ranges
from tabprobe.operators.ordering import bucket_count
from tabprobe.session import cut_lineage
from tabprobe.functions.aggregates import agg_row

METHODS = ("pearson", "spearman", "kendall")
PAIRS_PER_AGGREGATE = 50  # measured on 30 columns at sf0.1: 25 -> 32 s, 50 -> 18 s, 100 -> 22 s, 500 -> 299 s
CORR_DDL = "col_a string, col_b string, r double"


def _pairs(cols):
    return list(combinations(range(len(cols)), 2))


def _mirror(upper: DataFrame, cols: Sequence[str], diagonal: DataFrame) -> DataFrame:
    """Full matrix from upper-triangle cells plus diagonal cells."""
    lower = upper.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "r")
    order = {c: i for i, c in enumerate(cols)}
    idx = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(order[c]))])
    full = upper.unionByName(lower).unionByName(diagonal)
    return full.orderBy(idx[F.col("col_a")], idx[F.col("col_b")])


class ColumnFacts(NamedTuple):
    nulls: int
    infinite: int
    varies: bool  # two different values; exact where a variance test is not


def column_facts(wide: DataFrame, cols: Sequence[str]) -> list[ColumnFacts]:
    """What the later passes need to know of each column, in one aggregate."""
    inf = float("inf")
    row = agg_row(wide, [x for k, c in enumerate(cols) for x in (
        F.count_if(qcol(c).isNull()).alias(f"_n{k}"), F.count_if(F.abs(qcol(c)) == inf).alias(f"_i{k}"),
        F.coalesce(F.min(qcol(c)) < F.max(qcol(c)), F.lit(False)).alias(f"_v{k}"))])
    return [ColumnFacts(row[f"_n{k}"], row[f"_i{k}"], bool(row[f"_v{k}"])) for k in range(len(cols))]


def varying_pairs(wide: DataFrame, cols: Sequence[str], pairs, facts: list[ColumnFacts]) -> dict[tuple[int, int], bool]:
    """Per pair: do both columns vary over the pair's complete rows?

    ``corr`` raises under ANSI mode on a constant pair. The column facts decide every pair of
    null-free columns; only pairs that touch a column with missing values need masked min / max, in batches."""
    flags = {(i, j): facts[i].varies and facts[j].varies for i, j in pairs}
    masked = [(i, j) for i, j in pairs if (facts[i].nulls or facts[j].nulls) and flags[i, j]]
    guards = []
    for i, j in masked:
        both = qcol(cols[i]).isNotNull() & qcol(cols[j]).isNotNull()
        xi, xj = F.when(both, qcol(cols[i])), F.when(both, qcol(cols[j]))
        guards.append(F.coalesce((F.min(xi) < F.max(xi)) & (F.min(xj) < F.max(xj)), F.lit(False)))
    for start in range(0, len(guards), 4 * PAIRS_PER_AGGREGATE):
        got = wide.agg(*guards[start:start + 4 * PAIRS_PER_AGGREGATE]).first()
        for k, ok in enumerate(got):
            flags[masked[start + k]] = bool(ok)
    return flags


def _one_pass(wide: DataFrame, cols: Sequence[str]) -> dict[tuple[int, int], float]:
    """Pearson of all pairs of null-free, varying columns: one pass over a vector
    column; the matrix has columns x columns cells."""
    vec = VectorAssembler(inputCols=list(cols), outputCol="_x").transform(wide.select(*[qcol(c) for c in cols]))
    m = Correlation.corr(vec.select("_x"), "_x").first()[0].toArray()
    return {(i, j): float(m[i, j]) for i, j in _pairs(cols)}


def _pearson_upper(wide: DataFrame, cols: Sequence[str], facts: list[ColumnFacts], flags: dict[tuple[int, int], bool]) -> DataFrame:
    """Upper-triangle Pearson cells of the (already numeric, NaN-free) columns.
    Null-free finite columns are correlated in one pass, so scans do not grow with
    the number of pairs; pairs that touch missing values get one ``corr``
    aggregate per batch (pairwise complete); constant pairs are NULL."""
    pairs = _pairs(cols)
    whole = [k for k, f in enumerate(facts) if not f.nulls and not f.infinite and f.varies]
    names = [f"_p{k}" for k in whole]
    known = {}
    if len(whole) > 1:
        plain = wide.select(*[qcol(cols[k]).alias(n) for k, n in zip(whole, names)])
        known = {(whole[i], whole[j]): r for (i, j), r in _one_pass(plain, names).items()}
    rows = [(cols[i], cols[j], known.get((i, j))) for i, j in pairs if (i, j) in known or not flags[i, j]]
    parts = [wide.sparkSession.createDataFrame(rows, CORR_DDL)] if rows else []
    left = [(i, j) for i, j in pairs if flags[i, j] and (i, j) not in known]
    for start in range(0, len(left), PAIRS_PER_AGGREGATE):
        cells = [F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"),
                          F.corr(qcol(cols[i]), qcol(cols[j])).cast("double").alias("r"))
                 for i, j in left[start:start + PAIRS_PER_AGGREGATE]]
        parts.append(wide.agg(F.array(*cells).alias("_s")).select(F.inline("_s")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _diag(spark, cols: Sequence[str], facts: list[ColumnFacts] | None) -> DataFrame:
    """Diagonal cells: 1.0, except NULL for a constant or empty column
    (pandas gives NaN there for Pearson/Spearman; Kendall's diagonal is 1)."""
    return spark.createDataFrame([(c, c, 1.0 if facts is None or facts[k].varies else None) for k, c in enumerate(cols)], CORR_DDL)


def _numeric_wide(df: DataFrame, columns: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    cols = numeric_columns(df, columns)
    return df.select(*[clean_numeric(df, c).alias(c) for c in cols]), cols


def corr_pearson(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """S3: full Pearson matrix, long form."""
    wide, cols = _numeric_wide(df, columns)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], CORR_DDL)
    facts = column_facts(wide, cols)
    upper = _pearson_upper(wide, cols, facts, varying_pairs(wide, cols, _pairs(cols), facts))
    return _mirror(upper, cols, _diag(df.sparkSession, cols, facts))


# ------------------------------------------------------------------ ranks

def rank_vectors(wide: DataFrame, cols: Sequence[str], partners: Sequence[str]) -> tuple[DataFrame, list[dict[str, int]]]:
    """(row by row each column's average ranks ``_r<column>_<place>``, null where the column is missing; per
    column, the place of a partner's ranks). Place 0 holds the rank over all values, the others the ranks over
    the rows where a partner is present too; a partner that is never missing beside the column has place 0.

    A column is ranked once. The rank among the rows with a partner is that rank less the rows without
    the partner that come before (half of those that tie). The values are cut into ranges of about equal row
    counts (``value_ranges``), one aggregate counts the ranges, and the rows of a range are ranked together.
    Rows are shuffled once a column, by its range; a value that fills ranges has one of its own, whose
    rank the counts tell, so columns of few values are not shuffled at all."""
    spark, n = wide.sparkSession, bucket_count(wide, wide.count())
    flags = [f"_g{p}" for p in range(len(partners))]
    at = {c: f"_v{k}" for k, c in enumerate(cols)}
    rows = wide.select(*[(qcol(c) + F.lit(0.0)).alias(at[c]) for c in cols])
    ranges = value_ranges(rows, list(at.values()), n)

    cut = in_ranges(rows, {v: s for v, (s, _) in zip(at.values(), ranges)}, [f"_b{k}" for k in range(len(cols))])
    cells = cut.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_b{k}").alias("b"), *[
        F.col(at[p]).isNull().cast("int").alias(g) for g, p in zip(flags, partners)]) for k in range(len(cols))]))).where("b IS NOT NULL")
    # a row a range: at most 2 * MAX_RANGES of each column
    counts = cells.groupBy("k", "b").agg(F.count(F.lit(1)).cast("double").alias("_c"), *[F.sum(g).cast("double").alias(g) for g in flags]).toPandas()
    places, steps = [], []
    for k, c in enumerate(cols):
        mine = counts[counts["k"] == k].sort_values("b")
        need = [i for i, g in enumerate(flags) if mine[g].sum() > 0]
        places.append({p: need.index(i) + 1 if i in need else 0 for i, p in enumerate(partners)})
        w = mine[["_c", *[flags[i] for i in need]]].to_numpy()
        before, alone = np.zeros((len(ranges[k][0]), w.shape[1])), np.zeros(len(ranges[k][0]), bool)
        before[mine["b"]] = np.cumsum(w, axis=0) - w
        tied = np.zeros_like(before)
        tied[mine["b"]] = w
        alone[ranges[k][1]] = True
        steps.append((not alone[mine["b"]].all(), len(need), k, need, before, tied, alone))
    for moved, _, k, need, before, tied, alone in sorted(steps, key=lambda x: x[:3]):
        out = [f"_r{k}_{i}" for i in range(len(need) + 1)]
        keep = [c for c in rows.columns if c != f"_v{k}"]
        rows = in_ranges(rows, {f"_v{k}": ranges[k][0]}, ["_b"])
        if moved:
            apart = F.col("_b").isNull() | (F.col("_b").isin(ranges[k][1]) if ranges[k][1] else F.lit(False))
            # rows of a missing value or of a range of one value are spread over all tasks
            key = F.when(apart, -1 - F.pmod(F.xxhash64(*rows.columns), F.lit(n)).cast("int")).otherwise(F.col("_b"))
            run = _ranks_of_range(f"_v{k}", [at[partners[i]] for i in need], keep, out, before, tied)
            rows = rows.withColumn("_p", key).repartition(n, "_p").groupBy("_p").applyInPandas(run, ", ".join(f"{c} double" for c in [*keep, *out]))
        else:
            listed = [(b, *_average_ranks(before[b], tied[b]).tolist()) for b in np.flatnonzero(alone).tolist()]
            place = spark.createDataFrame(listed, "_b int, " + ", ".join(f"{c} double" for c in out))
            rows = rows.join(F.broadcast(place), "_b", "left").select(*keep, *out)
        at[cols[k]] = out[0]
    return rows, places


def _average_ranks(before: np.ndarray, tied: np.ndarray) -> np.ndarray:
    """Ranks of a value over all rows and over the rows with each partner, from the rows (and, of them, those
    without each partner) before it and tied with it; last axis: all, partners."""
    full = before[..., :1] + (tied[..., :1] + 1) / 2.0
    return np.concatenate([full, full - before[..., 1:] - tied[..., 1:] / 2.0], axis=-1)


def _ranks_of_range(value: str, partners: list[str], keep: list[str], out: list[str], before: np.ndarray, tied: np.ndarray):
    """Function of one group of ``rank_vectors``: the rows of one range, or rows whose ranks the counts tell."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ranks = np.full((len(rows), len(out)), np.nan)
        if rows["_p"].iloc[0] < 0:
            b = rows["_b"].to_numpy(np.float64, na_value=np.nan)
            there = ~np.isnan(b)
            b = b[there].astype(np.int64)
            ranks[there] = _average_ranks(before[b], tied[b])
        else:
            v = rows[value].to_numpy(np.float64)
            order = np.argsort(v)
            v = v[order]
            first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            w = np.column_stack([np.ones(len(v)), *[rows[p].isna().to_numpy()[order] for p in partners]])
            same = np.add.reduceat(w, first, axis=0)
            mine = _average_ranks(before[int(rows["_p"].iloc[0])] + np.cumsum(same, axis=0) - same, same)
            ranks[order] = np.repeat(mine, np.diff(np.append(first, len(v))), axis=0)
        return rows[keep].assign(**{c: ranks[:, i] for i, c in enumerate(out)})
    return run


def corr_spearman(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson on average ranks, ranked on each pair's complete rows.

    Every column is ranked once (``rank_vectors``) and each pair is one ``corr`` over its two rank
    columns, all in one aggregate; beyond ``PAIRS_PER_AGGREGATE`` pairs the ranks are written first."""
    wide, cols = _numeric_wide(df, columns)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], CORR_DDL)
    facts = column_facts(wide, cols)
    partners = [c for c, f in zip(cols, facts) if f.nulls]
    ranked, places = rank_vectors(wide, cols, partners)
    index = {c: i for i, c in enumerate(cols)}
    # ranks vary exactly where the raw values of the pair's rows vary
    flags = varying_pairs(wide, cols, _pairs(cols), facts)
    parts, complete = [], []
    if len(flags) > PAIRS_PER_AGGREGATE:
        ranked = cut_lineage(ranked)
        complete = [c for c in cols if c not in partners]
    if len(complete) >= 2:
        plain = ranked.select(*[F.col(f"_r{index[c]}_0").alias(c) for c in complete])
        mine = [facts[index[c]]._replace(infinite=0) for c in complete]  # ranks are finite
        parts.append(_pearson_upper(plain, complete, mine, {(i, j): mine[i].varies and mine[j].varies for i, j in _pairs(complete)}))
    mixed = [(i, j) for (i, j), ok in flags.items() if ok and not (cols[i] in complete and cols[j] in complete)]
    for start in range(0, len(mixed), PAIRS_PER_AGGREGATE):
        cells = [F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"),
                          F.corr(f"_r{i}_{places[i].get(cols[j], 0)}", f"_r{j}_{places[j].get(cols[i], 0)}").alias("r"))
                 for i, j in mixed[start:start + PAIRS_PER_AGGREGATE]]
        parts.append(ranked.agg(F.array(*cells).alias("_s")).select(F.inline("_s")))
    allp = df.sparkSession.createDataFrame([(cols[i], cols[j]) for i, j in _pairs(cols)],
                                           "col_a string, col_b string")
    upper = parts[0] if parts else df.sparkSession.createDataFrame([], CORR_DDL)
    for p in parts[1:]:
        upper = upper.unionByName(p)
    upper = allp.join(upper, ["col_a", "col_b"], "left")
    return _mirror(upper, cols, _diag(df.sparkSession, cols, facts))


# ------------------------------------------------------------------ Kendall

def corr_kendall(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Kendall tau-b, pairwise complete, for every column pair at once."""
    wide, cols = _numeric_wide(df, columns)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], CORR_DDL)
    pairs = _pairs(cols)
    n0 = F.col("n") * (F.col("n") - 1) / 2
    concordant = n0 - F.col("n1") - F.col("n2") + F.col("n3") - F.col("d")
    den = F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2")))
    tau = pair_counts(wide, cols, pairs).select("pair", F.when(den > 0, (concordant - F.col("d")) / den).alias("r"))
    listed = df.sparkSession.createDataFrame([(k, cols[i], cols[j]) for k, (i, j) in enumerate(pairs)], "pair int, col_a string, col_b string")
    upper = listed.join(tau, "pair", "left").select("col_a", "col_b", "r")
    return _mirror(upper, cols, _diag(df.sparkSession, cols, None))


def correlation_matrix(df: DataFrame, method: str = "pearson",
                       columns: Sequence[str] | None = None) -> DataFrame:
    """V9 / dispatcher: long matrix including the diagonal and both triangles."""
    if method == "pearson":
        return corr_pearson(df, columns)
    if method == "spearman":
        return corr_spearman(df, columns)
    if method == "kendall":
        return corr_kendall(df, columns)
    raise ValueError(f"unknown correlation method: {method!r}")


def correlation_summary(matrix: DataFrame, columns: Sequence[str],
                        threshold: float = 0.5) -> DataFrame:
    """Upper-triangle pairs (in ``columns`` order) with |r| >= threshold,
    labelled strong (|r| >= 0.7) or moderate, by |r| descending."""
    order = {c: i for i, c in enumerate(columns)}
    idx = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(order[c]))])
    r = F.col("r")
    return (matrix.where((idx[F.col("col_a")] < idx[F.col("col_b")]) & r.isNotNull()
                         & (F.abs(r) >= threshold))
                  .select("col_a", "col_b", "r",
                          F.when(F.abs(r) >= 0.7, "strong").otherwise("moderate").alias("strength"))
                  .orderBy(F.abs(F.col("r")).desc(), "col_a", "col_b"))


def strong_correlations(df: DataFrame, method: str = "pearson", threshold: float = 0.5,
                        columns: Sequence[str] | None = None) -> DataFrame:
    """S6 over a table: matrix by ``method`` then the summary."""
    cols = numeric_columns(df, columns)
    return correlation_summary(correlation_matrix(df, method, cols), cols, threshold)
