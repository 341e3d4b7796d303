"""Approximate nearest neighbours by inner product: multi-index hashing of learned binary codes.

1. Codes (``BITS`` bits): signs of the principal components of a sample after learned
   rotations (iterative quantisation: the rotation that brings the components closest to
   their signs, several starts side by side until the bits are full).
2. The radius is learned too: that within which a share ``REACH`` of the true
   neighbours of ``SAMPLE_QUERIES`` queries, found among all rows, have their codes.
3. Codes are cut into ``PARTS`` substrings, each with an index of its own. Codes within a
   radius r differ by at most r // PARTS bits in one substring at least (pigeonhole), so probing
   the buckets that near in every index retrieves every code within the radius.
   A code is taken from the first index that finds it.
4. The rows retrieved are ranked by inner products of the original vectors.
   A query that finds too few rows is asked again with a larger radius, in the end
   with all bits, so it gets k rows whenever there are so many.

Scale: an index is cut into pages by the first bits of its substring, about ``PAGE_ROWS``
vectors each; a page with more (near copies) is split by hash. A query is sent to the
pages whose first bits its ball can reach. A page is opened once and queries are streamed
through it; the pages of its own first bits come first and give the score that rows of other pages
must reach. Equal vectors are one entry with their k + 1 smallest ids (no other can be among
the k best), equal queries are asked once. The fitting sample is bounded: ``SAMPLE_ROWS`` vectors
reach the driver for the codes, ``SAMPLE_QUERIES`` queries for the radius; every row is indexed.

Defined results: vectors that are null, empty, all zero or hold null or non-finite components
take no part, nor do rows without an id; vectors are only compared with vectors of their own length;
rows with the query's id are not its candidates; rows that repeat id and vector are one; a repeated
query id is asked once (its smallest vector); ties go to the smaller id; fewer than k candidates
give all of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.llm.pages import bytes_matrix, serve
from tabprobe.session import cut_lineage

BITS = 128
PARTS = 4
WIDTH = BITS // PARTS  # bits of a substring
SAMPLE_ROWS = 4096  # documented bound of the sample that codes are learned from
SAMPLE_QUERIES = 128  # documented bound of the queries that the radius is learned from
REACH = 0.975  # share of the sample queries' neighbours within the radius
PAGE_ROWS = 8192
BLOCK = 64  # queries of a page handled at once


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


class Codes:
    """Mean and projection learned from a sample; picklable."""

    def __init__(self, sample: np.ndarray, steps: int = 40, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        axes = np.linalg.svd(centred, full_matrices=False)[2][:BITS].T
        parts = centred @ axes
        width = axes.shape[1]
        out = []
        for _ in range(-(-BITS // width)):
            turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
            for _ in range(steps):
                u, _, w = np.linalg.svd(np.where(parts @ turn > 0, 1.0, -1.0).T @ parts)
                turn = (u @ w).T
            out.append(axes @ turn)
        self.map = np.concatenate(out, axis=1)[:, :BITS]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, PARTS) substrings as unsigned 32-bit numbers."""
        d = min(vectors.shape[1], len(self.mean))
        bits = (vectors[:, :d] - self.mean[:d]) @ self.map[:d] > 0
        return np.packbits(bits, axis=1).view(">u4").astype(np.uint32)


def _matrices(col):
    """(rows, matrix) of the vectors of an array column, by length."""
    size = np.diff(np.asarray(col.offsets)) if len(col) else np.zeros(0, int)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    off = np.concatenate([[0], np.cumsum(size)])
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield at, flat[(off[at][:, None] + np.arange(d)[None, :])]


def _code_task(codes, name, schema):
    def run(batches):
        for batch in batches:
            rest = [batch.column(c) for c in batch.schema.names if c != name]
            for at, m in _matrices(batch.column(name)):
                code = codes.value.of(m.astype(np.float64))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([
                    *[c.take(take) for c in rest], pa.array(np.full(len(at), m.shape[1]), pa.int32()),
                    pa.array([r.tobytes() for r in m], pa.binary()), pa.array(list(code.astype(np.int64)), pa.list_(pa.int64()))], schema=schema)
    return run


def coded(rows: DataFrame, name: str, codes) -> DataFrame:
    """The rows with d (length), vec (the vector's bytes) and code (substrings) instead of the vector."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType
    kind = StructType([f for f in rows.schema.fields if f.name != name]).add("d", IntegerType()).add("vec", BinaryType()).add("code", ArrayType(LongType()))
    return rows.mapInArrow(_code_task(codes, name, to_arrow_schema(kind)), kind)


def _codes_matrix(col) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.uint32).reshape(-1, PARTS)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which codes differ."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _reach_task(shared, dtype, k):
    """For each sample query its k best rows of the task: (query, score, bits apart)."""
    def run(batches):
        queries, codes, lengths = shared.value
        best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in queries]
        for batch in batches:
            size = batch.column("d").to_numpy()
            code = _codes_matrix(batch.column("code"))
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                m = bytes_matrix(batch.column("vec").take(pa.array(at)), dtype, d).astype(np.float64)
                for i in np.flatnonzero(lengths == d):
                    s = m @ queries[i]
                    top = np.argsort(-s, kind="stable")[:k]
                    s = np.concatenate([best[i][0], s[top]])
                    h = np.concatenate([best[i][1], distance(code[at[top]], codes[i])])
                    top = np.argsort(-s, kind="stable")[:k]
                    best[i] = s[top], h[top]
        for i, (s, h) in enumerate(best):
            if len(s):
                yield pa.RecordBatch.from_pydict({"q": np.full(len(s), i), "score": s, "bits": h})
    return run


def learn_radius(index: DataFrame, asked: DataFrame, dtype: str, k: int) -> int:
    """Bits within which a share REACH of the sample queries' true neighbours lie."""
    some = asked.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE_QUERIES).select("d", "vec", "code").collect()
    queries = [np.frombuffer(r["vec"], dtype).astype(np.float64) for r in some]
    shared = index.sparkSession.sparkContext.broadcast(  # SAMPLE_QUERIES vectors
        (queries, np.array([r["code"] for r in some], np.uint32), np.array([r["d"] for r in some])))
    found = index.mapInArrow(_reach_task(shared, dtype, k), "q bigint, score double, bits bigint")
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "bits")
    bits = [r["bits"] for r in found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("bits").collect()]
    return int(np.quantile(bits, REACH, method="higher")) if bits else BITS


class _Page:
    """The rows of a page in order of the page's substring, and its distinct values (buckets)."""

    def __init__(self, rows: pa.Table, dtype):
        rows = rows.combine_chunks()
        self.part, d = rows["j"][0].as_py(), rows["d"][0].as_py()
        code = _codes_matrix(rows["code"].combine_chunks())
        order = np.argsort(code[:, self.part], kind="stable")
        self.code = code[order]
        self.vec = bytes_matrix(rows["vec"], dtype, d)[order]
        ids = rows["ids"].combine_chunks().take(pa.array(order))
        self.ids, self.n_ids = ids.flatten().to_numpy(), ids.value_lengths().to_numpy().astype(np.int64)
        self.first_id = np.cumsum(self.n_ids) - self.n_ids
        self.buckets, self.start, self.size = np.unique(self.code[:, self.part], return_index=True, return_counts=True)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... size[i] numbers of each i."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _ranked(query: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int):
    """(order by query, best score and tie; rank within the query; place of the query's k-th or a later row)."""
    order = np.lexsort((tie, -score, query))
    first = np.searchsorted(query[order], query[order])
    return order, np.arange(len(order)) - first, np.minimum(first + k - 1, max(len(order) - 1, 0))


def _answer(dtype, radius, k):
    near = radius // PARTS
    schema = pa.schema([("rid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(page, batch):
        code = _codes_matrix(batch.column("code"))
        vec = bytes_matrix(batch.column("vec"), dtype, page.vec.shape[1])
        rid = batch.column("rid").to_numpy()
        floor = batch.column("floor").fill_null(-np.inf).to_numpy()
        for lo in range(0, len(rid), BLOCK):
            q, b = np.nonzero(np.bitwise_count(code[lo:lo + BLOCK, page.part, None] ^ page.buckets[None, :]) <= near)
            got = [], [], []
            for at in range(0, len(q), 1 << 16):  # a bounded number of buckets at once
                x, y = q[at:at + (1 << 16)], b[at:at + (1 << 16)]
                row, x = _spread(page.start[y], page.size[y]), np.repeat(x, page.size[y])
                apart = np.bitwise_count(page.code[row] ^ code[lo + x])
                ok = apart.sum(axis=1, dtype=np.int64) <= radius
                ok &= (apart[:, :page.part] > near).all(axis=1)  # no earlier index finds it
                row, x = row[ok], x[ok]
                for i in range(0, len(row), 1 << 15):
                    r, z = row[i:i + (1 << 15)], x[i:i + (1 << 15)]
                    got[0].append(z)
                    got[1].append((page.vec[r].astype(np.float64) * vec[lo + z].astype(np.float64)).sum(axis=1))
                    got[2].append(r)
            if not got[0]:
                continue
            x, s, row = (np.concatenate(g) for g in got)
            some = s >= floor[lo + x]
            x, s, row = x[some], s[some], row[some]
            order, rank, last = _ranked(x, s, row, k)
            x, s, row = x[order], s[order], row[order]
            keep = (rank < k) | (s == s[last])  # entries tied with the k-th stay: an id among theirs may be smaller
            x, s, row = x[keep], s[keep], row[keep]
            ids = page.ids[_spread(page.first_id[row], page.n_ids[row])]
            x, s = np.repeat(x, page.n_ids[row]), np.repeat(s, page.n_ids[row])
            order, rank, _ = _ranked(x, s, ids, k)
            keep = order[rank < k]
            x, s, ids = x[keep], s[keep], ids[keep]
            yield pa.RecordBatch.from_arrays([pa.array(rid[lo + x]), pa.array(ids), pa.array(s)], schema=schema)
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, page_rows: int = PAGE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score. ``vectors``: vec_id, v (array of float or double); ``queries``: query_id, qv."""
    spark = vectors.sparkSession
    rows = vectors.where("vec_id IS NOT NULL").where(usable(F.col("v"))).select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    dtype = "<f4" if dict(rows.dtypes)["v"] == "array<float>" else "<f8"
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    entries = (rows.distinct().withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1)
                   .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))  # at most k + 1 ids
    entries = cut_lineage(entries)
    picked = [r["v"] for r in entries.orderBy(F.xxhash64("v"), "v").limit(SAMPLE_ROWS).select("v").collect()]
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not picked:
        return empty
    width = Counter(map(len, picked)).most_common(1)[0][0]
    codes = spark.sparkContext.broadcast(Codes(np.array([v for v in picked if len(v) == width])))  # BITS vectors
    ask = cut_lineage(queries.where("query_id IS NOT NULL").where(usable(F.col("qv")))
                             .groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.min("qv").alias("qv")))
    distinct = cut_lineage(ask.select("qv").distinct().withColumn("rid", F.monotonically_increasing_id()))
    index = cut_lineage(coded(entries, "v", codes))
    asked = cut_lineage(coded(distinct, "qv", codes))
    n, n_asked = index.count(), asked.count()
    if not n_asked:
        return empty
    radius = learn_radius(index, asked, dtype, k + 1)

    lead = max(0, min(WIDTH, int(np.ceil(np.log2(max(1, n / page_rows))))))  # first bits of a substring that name a page
    cut = lambda df: (df.select("*", F.posexplode("code").alias("j", "sub"))
                        .withColumn("lead", F.shiftrightunsigned("sub", WIDTH - lead)).drop("sub"))
    pieces = cut_lineage(cut(index.select("d", "code")).groupBy("j", "lead", "d").agg(F.ceil(F.count("*") / F.lit(page_rows)).alias("pieces")))
    key = ["j", "lead", "d", "piece"]
    pages = (cut(index).join(pieces, ["j", "lead", "d"]).withColumn("piece", F.pmod(F.xxhash64("vec"), F.col("pieces")))
                       .select(*key, "ids", "vec", "code"))
    best = Window.partitionBy("rid").orderBy(F.col("score").desc(), "vec_id")

    def top(rows):
        return rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")

    def ask_pages(probes, r):
        got = serve(pages, probes.select(*key, "rid", "vec", "code", "floor"), key, lambda t: _Page(t, dtype), _answer(dtype, r, k + 1),
                    "rid bigint, vec_id bigint, score double")
        return cut_lineage(top(got))
    found, pending = None, asked
    steps = sorted({min(BITS, radius + x) for x in (0, BITS // 8, 3 * BITS // 8)} | {BITS})
    for r in steps:
        near = r // PARTS
        masks = F.expr(f"filter(sequence(0L, {2 ** lead - 1}L), x -> bit_count(x) <= {near})")
        probes = (cut(pending).withColumn("mask", F.explode(masks)).withColumn("lead", F.col("lead").bitwiseXOR(F.col("mask")))
                              .join(pieces, ["j", "lead", "d"]).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))))
        # the pages of the query's own first bits come first; the others give only what reaches the k-th score found there
        home = F.expr("mask = 0 AND piece = 0")
        got = ask_pages(probes.where(home).withColumn("floor", F.lit(None).cast("double")), r)
        floors = got.groupBy("rid").agg(F.count("*").alias("c"), F.min("score").alias("floor")).where(F.col("c") >= k + 1).drop("c")
        got = got.unionAll(ask_pages(probes.where(~home).join(floors, "rid", "left"), r))
        got = cut_lineage(top(got))
        if r == BITS:
            found = got if found is None else found.unionAll(got)
            break
        full = got.groupBy("rid").count().where(F.col("count") >= k + 1).select("rid")
        done = got.join(full, "rid", "left_semi")
        found = done if found is None else found.unionAll(done)
        pending = cut_lineage(pending.join(full, "rid", "left_anti"))
        if pending.isEmpty():
            break
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = ask.join(distinct, "qv").select("query_id", "rid").join(found, "rid").where("vec_id <> query_id")
    return out.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
