"""Exact quantiles (linear interpolation) by distributed selection.

``percentile`` keeps a value->count map per group and merges it in one task,
which is unbounded for a high-cardinality column; sorting every value is more
work than needed. Instead, per numeric column, at every size alike:

1. one aggregate gives count, sum, min, max and, from a bounded rank sketch
   (``percentile_approx``), an interval around every wanted rank;
2. a second one counts the values below and inside each interval exactly (and
   sums powers of the deviation from the mean when moments are wanted); an
   interval that misses its rank is widened to the whole column;
3. only values inside the intervals -- a fixed small share -- are value-counted
   and ranked with the distributed running sum.

A grouped variant (``quantiles_from_counts``) serves per-group quantiles,
where the number of groups is data-dependent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.functions.aggregates import agg_row
from tabprobe.functions.columns import clean_numeric, qcol
from tabprobe.operators.ordering import with_running_sum
from tabprobe.session import cut_lineage

SKETCH = 1000  # rank error of the sketch: 1 / SKETCH of the rows
MARGIN = 0.002  # half width of an interval, as a share of the rows


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, v) for every non-null numeric cell, NaN read as missing."""
    wide = df.select(*[clean_numeric(df, c).alias(c) for c in columns])
    long = wide.unpivot([], [qcol(c) for c in columns], "column_name", "v")
    return long.where(F.col("v").isNotNull())


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, v, c): distinct non-null values per column with counts."""
    return long_values(df, columns).groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("c"))


class ColumnProfile:
    """Per numeric column: count, mean, min, max, intervals around the wanted
    ranks and exact central moments (optional). Every job returns one row."""

    def __init__(self, df: DataFrame, columns: Sequence[str], moments: bool = False, probs: Sequence[float] = ()):
        self.df, self.columns, self.moments, self.probs = df, list(columns), moments, tuple(float(p) for p in probs)
        k = len(self.columns)
        self.wide = df.select(*[clean_numeric(df, c).alias(f"_q{i}") for i, c in enumerate(self.columns)])
        marks = [min(1.0, max(0.0, p + d)) for p in self.probs for d in (-MARGIN, MARGIN)]
        grid = F.array(*[F.lit(m) for m in marks]) if marks else None
        row = agg_row(self.wide, [e for i in range(k) for e in (
            F.count(f"_q{i}").alias(f"n{i}"), F.sum(f"_q{i}").alias(f"s{i}"),
            F.min(f"_q{i}").alias(f"lo{i}"), F.max(f"_q{i}").alias(f"hi{i}"),
            *([F.percentile_approx(F.col(f"_q{i}"), grid, SKETCH).alias(f"p{i}")] if marks else []))])
        self.n = [int(row[f"n{i}"]) for i in range(k)]
        self.mean = [row[f"s{i}"] / self.n[i] if self.n[i] else None for i in range(k)]
        self.min = [row[f"lo{i}"] for i in range(k)]
        self.max = [row[f"hi{i}"] for i in range(k)]
        self.live = [i for i in range(k) if self.n[i] > 0]
        # disjoint intervals [lo, hi] per column that hold the wanted ranks
        self.spans = {i: _merged([(row[f"p{i}"][2 * j], row[f"p{i}"][2 * j + 1]) for j in range(len(self.probs))]) for i in self.live} if marks else {}
        self._second_pass()

    def _second_pass(self) -> None:
        aggs = []
        for i in self.live:
            x = F.col(f"_q{i}")
            if self.moments:
                d = x - F.lit(float(self.mean[i]))
                aggs += [F.sum(d).alias(f"a{i}"), F.sum(d * d).alias(f"b{i}"), F.sum(d * d * d).alias(f"c{i}"),
                         F.sum(d * d * d * d).alias(f"e{i}")]
            for j, (lo, hi) in enumerate(self.spans.get(i, [])):
                aggs += [F.count_if(x < F.lit(lo)).alias(f"u{i}_{j}"), F.count_if((x >= F.lit(lo)) & (x <= F.lit(hi))).alias(f"v{i}_{j}")]
        self.second = agg_row(self.wide, aggs) if aggs else {}
        self.bounds: dict[int, list] = {}  # (lo, hi, values below, values inside)
        for i, spans in self.spans.items():
            found = [(lo, hi, int(self.second[f"u{i}_{j}"]), int(self.second[f"v{i}_{j}"])) for j, (lo, hi) in enumerate(spans)]
            ranks = {r for p in self.probs for r in _ranks(p, self.n[i])}
            if not all(any(u <= r < u + v for _, _, u, v in found) for r in ranks):
                found = [(self.min[i], self.max[i], 0, self.n[i])]  # exact whatever the sketch said
            self.bounds[i] = found

    def central_moments(self, i: int) -> tuple[float, float, float, float] | None:
        """(mean, m2, m3, m4) -- sums of powers of deviations, exact two-pass."""
        n = self.n[i]
        if n == 0:
            return None
        s1, s2, s3, s4 = (self.second[f"{k}{i}"] for k in "abce")
        m2 = s2 - s1 * s1 / n
        m3 = s3 - 3 * s1 * s2 / n + 2 * s1 ** 3 / n ** 2
        m4 = s4 - 4 * s1 * s3 / n + 6 * s1 * s1 * s2 / n ** 2 - 3 * s1 ** 4 / n ** 3
        return self.mean[i] + s1 / n, m2, m3, m4

    def quantiles(self) -> DataFrame:
        """(column_name, prob, value): only the intervals are value-counted and ranked."""
        spark = self.df.sparkSession
        targets = []
        for i in self.live:
            for p in self.probs:
                for r in _ranks(p, self.n[i]):
                    j = next(j for j, (_, _, u, v) in enumerate(self.bounds[i]) if u <= r < u + v)
                    targets.append((f"{i}:{j}", r - self.bounds[i][j][2], self.columns[i], p, p * (self.n[i] - 1)))
        if not targets:
            return spark.createDataFrame([], "column_name string, prob double, value double")
        cells, hit = [], F.lit(False)
        for i in self.live:
            x, inside = F.col(f"_q{i}"), F.lit(None).cast("string")
            for j, (lo, hi, _, _) in enumerate(self.bounds[i]):
                inside = F.when((x >= F.lit(lo)) & (x <= F.lit(hi)), F.lit(f"{i}:{j}")).otherwise(inside)
            cells.append(F.struct(inside.alias("k"), x.alias("x")))
            hit = hit | inside.isNotNull()
        values = self.wide.where(hit).select(F.inline(F.array(*cells))).where(F.col("k").isNotNull())
        vc = cut_lineage(values.groupBy("k", "x").agg(F.count(F.lit(1)).alias("c")))
        ranked = with_running_sum(vc, "k", ["x"], "c", name="before")
        tdf = spark.createDataFrame(targets, "_k string, _r long, column_name string, prob double, _pos double")
        picked = ranked.join(F.broadcast(tdf), (F.col("k") == F.col("_k"))  # columns x probabilities x 2 rows
                             & (F.col("_r") >= F.col("before")) & (F.col("_r") < F.col("before") + F.col("c")))
        frac = F.col("_pos") - F.floor("_pos")
        agg = picked.groupBy("column_name", "prob").agg(F.first("_pos").alias("_pos"), F.min("x").alias("_lo"),
                                                        F.max("x").alias("_hi"))
        return agg.select("column_name", "prob", _interpolate(frac).alias("value"))


def _ranks(p: float, n: int) -> list[int]:
    """The 0-based ranks around p * (n - 1)."""
    pos = p * (n - 1)
    return sorted({int(pos // 1), int(-(-pos // 1))})


def _merged(spans: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _interpolate(frac):
    """lo + (hi - lo) * frac, exact at the neighbours (also for infinite values)."""
    lo, hi = F.col("_lo"), F.col("_hi")
    return F.when((frac == 0) | (lo == hi), lo).otherwise(lo + (hi - lo) * frac)


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Long table (column_name, prob, value) of exact linear-interpolated quantiles."""
    return ColumnProfile(df, columns, probs=probs).quantiles()


def quantiles_from_counts(vc: DataFrame, probs: Sequence[float]) -> DataFrame:
    """(column_name, prob, value) from a (column_name, v, c) value-count table,
    for a data-dependent number of groups: a distributed running sum over
    range buckets, then a join with the (group x probability) targets."""
    vc = cut_lineage(vc)  # read by several jobs
    ranked = with_running_sum(vc, "column_name", ["v"], "c", name="before")
    sizes = vc.groupBy("column_name").agg(F.sum("c").alias("_n"))
    pos = F.col("prob") * (F.col("_n") - 1)
    targets = (sizes.select(F.col("column_name").alias("_t"), "_n",
                            F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
                    .withColumn("_pos", pos)
                    .withColumn("_r", F.explode(F.array_distinct(
                        F.array(F.floor("_pos"), F.ceil("_pos"))))))
    # one target row per (group, probability, rank), joined on the group
    hits = ranked.join(
        targets,
        (F.col("column_name") == F.col("_t")) & (F.col("_r") >= F.col("before"))
        & (F.col("_r") < F.col("before") + F.col("c")))
    picked = hits.groupBy("column_name", "prob").agg(
        F.first("_pos").alias("_pos"),
        F.min_by("v", "_r").alias("_lo"),
        F.max_by("v", "_r").alias("_hi"))
    frac = F.col("_pos") - F.floor("_pos")
    return picked.select("column_name", "prob", _interpolate(frac).alias("value"))


def quantile_columns(q: DataFrame, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Pivot a (column_name, prob, value) table to one column per probability."""
    return q.groupBy("column_name").agg(*[
        F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("value"))).alias(n)
        for p, n in zip(probs, names)])
