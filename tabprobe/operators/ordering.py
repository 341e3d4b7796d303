"""Distributed positions and running sums.

Row positions and weighted ranks are the backbone of the positional operators
(row ids, paging), of exact quantiles and of average ranks.
A global ``row_number() over (order by k)`` runs in a single task, so instead,
at every size alike:

1. range *buckets* are fixed once from a bounded sample of the order key and
   written into the plan as a balanced comparison tree -- a deterministic
   function of the row, so every branch of the plan (and every retry after a
   lost executor) puts a row in the same bucket; the number of buckets follows
   the measured row count, and missing keys come first, as in Spark's order;
2. a window partitioned by bucket gives the position / running sum inside the
   bucket (one shuffle, buckets balanced by the sample; a key value that fills
   several buckets is spread over them by a row hash);
3. bucket totals are prefix-summed; only buckets with a non-zero offset -- at
   most one per bucket boundary -- are broadcast back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.functions.columns import qcol
from tabprobe.session import cut_lineage

SAMPLE_PER_BUCKET = 64
MAX_SAMPLE = 65_536  # keys that reach the driver
ROWS_PER_BUCKET = 250_000
MIN_ROWS = 500  # smaller buckets are not worth a task
MAX_BUCKETS = 4096  # the comparison tree holds one literal per boundary: keep the plan small
SUB_BUCKETS = 1024  # bucket id = base * SUB_BUCKETS + sub (sub spreads a hot key)
SAMPLE_SEED = 7


def default_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def bucket_count(df: DataFrame, rows: int) -> int:
    """Buckets for ``rows`` measured rows: enough to keep a task near
    ``ROWS_PER_BUCKET`` rows (a window task sorts and spills beyond memory), and
    the session's parallelism when there are rows for it."""
    spread = min(default_partitions(df), -(-rows // MIN_ROWS))
    return max(1, min(MAX_BUCKETS, max(spread, -(-rows // ROWS_PER_BUCKET))))


def _before(k: Column, b, inclusive: bool) -> Column:
    """k < b (or k <= b) in Spark's ascending order: missing first, NaN last."""
    if b is None:
        return k.isNull() if inclusive else F.lit(False)
    return k.isNull() | (k <= F.lit(b) if inclusive else k < F.lit(b))


def _lex_le(keys: Sequence[Column], bound: tuple) -> Column:
    """keys <= bound in lexicographic order."""
    cond = _before(keys[-1], bound[-1], True)
    for i in range(len(keys) - 2, -1, -1):
        cond = _before(keys[i], bound[i], False) | (keys[i].eqNullSafe(F.lit(bound[i])) & cond)
    return cond


def _lex_eq(keys: Sequence[Column], bound: tuple) -> Column:
    cond = F.lit(True)
    for k, b in zip(keys, bound):
        cond = cond & k.eqNullSafe(F.lit(b))
    return cond


def _sample_bounds(df: DataFrame, order_cols: Sequence[str], n: int) -> list[tuple]:
    """n-1 boundary keys (with repeats for hot keys) from a bounded uniform
    sample: the rows with the smallest per-row hash (one pass, TakeOrdered keeps
    at most ``MAX_SAMPLE`` rows per task), sorted by Spark."""
    if n <= 1:
        return []
    want = min(n * SAMPLE_PER_BUCKET, max(MAX_SAMPLE, 4 * n))
    keys = [qcol(c) for c in order_cols]
    salt = F.xxhash64(*keys, F.monotonically_increasing_id(), F.lit(SAMPLE_SEED))
    names = [f"_k{i}" for i in range(len(keys))]
    picked = df.select(*[k.alias(c) for k, c in zip(keys, names)], salt.alias("_s")).orderBy("_s").limit(want)
    sample = [tuple(r) for r in picked.drop("_s").orderBy(*names).collect()]
    if not sample:
        return []
    return [sample[(len(sample) * i) // n] for i in range(1, n)]


def _same(a: tuple, b: tuple) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))  # NaN equals NaN


def bucket_column(df: DataFrame, order_cols: Sequence[str], num_buckets: int | None = None,
                  spread: Sequence[str] | None = None) -> Column:
    """Deterministic range-bucket id (a long, increasing with the order key)."""
    n = min(num_buckets or bucket_count(df, df.count()), MAX_BUCKETS)
    bounds = _sample_bounds(df, order_cols, n)
    uniq: list[tuple] = []
    mult: list[int] = []
    for b in bounds:
        if uniq and _same(uniq[-1], b):
            mult[-1] += 1
        else:
            uniq.append(b)
            mult.append(1)
    keys = [qcol(c) for c in order_cols]

    def tree(lo: int, hi: int) -> Column:
        # buckets lo..hi; bucket k holds keys in (uniq[k-1], uniq[k]]
        if lo == hi:
            return F.lit(lo).cast("long")
        mid = (lo + hi) // 2
        return F.when(_lex_le(keys, uniq[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    base = tree(0, len(uniq)) if uniq else F.lit(0).cast("long")
    sub = F.lit(0).cast("long")
    hot = [(u, m) for u, m in zip(uniq, mult) if m > 1]
    if hot and spread:
        h = F.xxhash64(*[qcol(c) for c in spread])
        for u, m in hot:
            sub = F.when(_lex_eq(keys, u), F.pmod(h, F.lit(min(m, SUB_BUCKETS)))).otherwise(sub)
    return base * SUB_BUCKETS + sub


def with_running_sum(df: DataFrame, group_col: str | None, order_by: Sequence[str],
                     weight_col: str | None, name: str = "before",
                     num_buckets: int | None = None,
                     spread: Sequence[str] | None = None) -> DataFrame:
    """Append, per ``group_col`` (or over the whole table), the sum of
    ``weight_col`` (1 per row when None) over rows earlier in ``order_by``
    order (missing first): an exclusive running sum. Rows with equal keys are
    ordered arbitrarily (ROWS frame); pass unique keys for a deterministic
    result. Missing groups are one group."""
    return with_running_sums(df, group_col, order_by, {name: weight_col}, num_buckets, spread)


def with_running_sums(df: DataFrame, group_col: str | None, order_by: Sequence[str],
                      weights: Mapping[str, str | None], num_buckets: int | None = None,
                      spread: Sequence[str] | None = None) -> DataFrame:
    """``with_running_sum`` of several weights ({new column: weight column}) in one
    shuffle and one sort."""
    gcols = [group_col] if group_col else []
    keys = gcols + list(order_by)
    g = qcol(group_col) if group_col else F.lit(0)
    n = num_buckets or bucket_count(df, df.count())
    b = bucket_column(df, keys, n, spread)
    sums = list(enumerate(weights.items()))
    staged = df.withColumns({"_b": b, "_g": g} | {f"_w{k}": (qcol(w) if w else F.lit(1)).cast("long") for k, (_, w) in sums})
    staged = staged.repartition(n, "_b")
    local_w = (Window.partitionBy("_b", "_g").orderBy(*[qcol(c) for c in order_by])
                     .rowsBetween(Window.unboundedPreceding, -1))
    local = staged.withColumns({f"_local{k}": F.coalesce(F.sum(f"_w{k}").over(local_w), F.lit(0)) for k, _ in sums})
    totals = staged.groupBy("_b", "_g").agg(*[F.sum(f"_w{k}").alias(f"_tot{k}") for k, _ in sums])
    prior = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_b").alias("_ob"), F.col("_g").alias("_og"),
                            *[F.coalesce(F.sum(f"_tot{k}").over(prior), F.lit(0)).alias(f"_off{k}") for k, _ in sums])
    offsets = offsets.where(F.greatest(*[F.col(f"_off{k}") for k, _ in sums], F.lit(0)) > 0)  # at most one row per bucket boundary
    joined = local.join(F.broadcast(offsets),
                        (F.col("_b") == F.col("_ob")) & F.col("_g").eqNullSafe(F.col("_og")), "left")
    out = joined.withColumns({name: (F.coalesce(F.col(f"_off{k}"), F.lit(0)) + F.col(f"_local{k}")).cast("long") for k, (name, _) in sums})
    return out.drop("_b", "_g", "_ob", "_og", *[f"{x}{k}" for k, _ in sums for x in ("_w", "_off", "_local")])


class Directory:
    """Row counts of the range buckets of an order, which tell what bucket holds a
    position: rows at a few positions are then numbered without moving the others.
    One row a bucket reaches the driver."""

    def __init__(self, df: DataFrame, order_by: Sequence[str], num_buckets: int | None = None):
        self.df, self.order_by = df, list(order_by)
        self.bucket = bucket_column(df, order_by, num_buckets, spread=list(df.columns))
        self.starts: list[tuple[int, int, int]] = []  # (bucket, its first position, the next bucket's)
        self.rows = 0
        for b, c in sorted(tuple(r) for r in df.groupBy(self.bucket.alias("_b")).count().collect()):
            self.starts.append((b, self.rows, self.rows + c))
            self.rows += c

    def touched(self, intervals: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
        """(bucket, first position) of the buckets that hold a position of the sorted,
        disjoint inclusive intervals."""
        out, k = [], 0
        for b, lo, hi in self.starts:
            while k < len(intervals) and intervals[k][1] < lo:
                k += 1
            if k < len(intervals) and intervals[k][0] < hi:
                out.append((b, lo))
        return out

    def number(self, intervals: Sequence[tuple[int, int]], name: str = "row_id") -> DataFrame:
        """The rows of the touched buckets with their positions; only these are shuffled."""
        found = self.touched(intervals)
        staged = self.df.withColumn("_b", self.bucket).where(F.col("_b").isin([b for b, _ in found]) if found else F.lit(False))
        nth = F.row_number().over(Window.partitionBy("_b").orderBy(*[qcol(c) for c in self.order_by]))
        first = self.df.sparkSession.createDataFrame(found, "_b long, _first long")
        return staged.withColumn("_nth", nth).join(F.broadcast(first), "_b").withColumn(
            name, F.col("_first") + F.col("_nth") - 1).drop("_b", "_nth", "_first")


_POS_BITS = 33  # monotonically_increasing_id = (partition index << 33) + position


def with_row_id(df: DataFrame, order_by: Sequence[str] | None = None,
                name: str = "row_id", num_partitions: int | None = None) -> DataFrame:
    """Append a contiguous 0-based position.

    With ``order_by`` the position follows that order (ties in arbitrary order
    -- pass a unique key for a deterministic result). Without it the current
    partition order of a scan is used (file order), via the partition index and
    in-partition position; offsets come from per-partition counts. The input is
    checkpointed first, so both uses of it see the same partitions.
    """
    if order_by:
        return with_running_sum(df, None, order_by, None, name, num_partitions,
                                spread=list(df.columns))
    base = (cut_lineage(df).withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("_pid", F.shiftright("_mid", _POS_BITS)))
    counts = base.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid"), _POS_BITS)
    return (base.join(F.broadcast(offsets), "_pid")
                .withColumn(name, (F.col("_off") + local).cast("long"))
                .drop("_mid", "_pid", "_off"))
