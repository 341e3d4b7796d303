"""Small helpers shared by the operators: row numbers inside tasks, reliable
lineage cuts, bounded hash filters, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.session import cut_lineage

_POS_BITS = 33  # row id = (partition << 33) + position, as monotonically_increasing_id


def first_row_id() -> int:
    """Row id of a task's first row; call inside a task."""
    from pyspark import TaskContext
    ctx = TaskContext.get()
    return (ctx.partitionId() if ctx else 0) << _POS_BITS


BATCH_BYTES = 8 << 20  # Arrow batches sent to Python workers


def small_batches(spark) -> None:
    """Bound the Arrow batches of the session by ``BATCH_BYTES`` (Spark's own bound is 64 MB), so that a
    worker's memory does not follow the length of the texts; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    number = int(now[:-1]) if now[-1:].lower() == "b" and now[:-1].isdigit() else int(now) if now.lstrip("-").isdigit() else 0
    if number <= 0 or number > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def with_text(docs: DataFrame, cols: list[str], text_col: str) -> tuple[DataFrame, int]:
    """(the columns as c0, c1, ..., place of the text among them). A text that is a string and one of the
    columns is sent to the workers once; else it follows them."""
    small_batches(docs.sparkSession)
    out = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)], F.col(text_col).cast("string").alias("_text"))
    if text_col in cols and dict(docs.dtypes)[text_col] == "string":
        return out.drop("_text"), cols.index(text_col)
    return out, len(cols)


FILTER_BITS = 23  # 2**23 slots: 1 MiB whatever the data's size


def hash_filter(keys: DataFrame, col: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of ``2**bits`` slots with the slots of the 64-bit keys set.

    Built by Spark: one row per used 64-slot word reaches the driver, at most
    ``2**bits / 64`` rows whatever the number of keys. A full bitmap lets
    every key pass, which costs shuffle and no result."""
    rows = (keys.select(F.shiftrightunsigned(F.col(col), 64 - bits).alias("s")).where("s IS NOT NULL")
                .groupBy(F.expr("shiftright(s, 6)").alias("w"))
                .agg(F.expr("bit_or(shiftleft(1L, CAST(s & 63 AS INT)))").alias("b")).collect())
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    for w, b in rows:
        out[w] = np.uint64(b & 0xFFFFFFFFFFFFFFFF)
    return out


def may_contain(bitmap: np.ndarray, keys: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    """True where the filter holds the slot of a 64-bit key (uint64)."""
    slot = keys >> np.uint64(64 - bits)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def release(spark) -> None:
    """Let Spark drop the shuffle files of frames that are no longer referenced;
    it does so when the driver collects its garbage, which may be late."""
    import gc
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of the edges: the smallest node
    reachable. Alternates large-star and small-star steps; each round is
    written to the shared checkpoint folder, and hot nodes are pre-aggregated
    (``min`` per node) and joined under adaptive skew splitting."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut_lineage(e)
    for _ in range(max_rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour is linked to the smallest one around
        large = (both.join(low, "u").where("v > u")
                     .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: every smaller neighbour is linked to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                      .unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        new = cut_lineage(small)
        # done when every node has one neighbour and that neighbour is a root
        left = new.join(new.select(F.col("u").alias("x")).distinct(), F.col("v") == F.col("x"), "left_semi").limit(1).count()
        many = new.groupBy("u").count().where("count > 1").limit(1).count()
        e = new
        if not left and not many:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
