"""N-gram Jaccard join with signature trees.

A document's set holds its distinct word n-grams; two documents link when the
Jaccard similarity of their sets reaches ``num / den`` (compared in integers),
and the classes are the connected components of all links.

1. Equal sets are one class (64-bit digest). Counts of every document's
   n-grams tell the hot ones (in about one document of ``HOT_SHARE`` or more, by
   a table of fixed size, less what an even spread of all n-grams puts into a slot).
2. Candidates, without loss: in any fixed order of the n-grams, the first
   ``n - ceil(t n) + 1`` ones of two linked sets meet. The order used puts a fixed
   share of the n-grams first, by document count, then the others, then hot
   ones, so sets with enough n-grams of their own meet no other set. Sets
   that meet, directly or over others, form a family; nothing outside it can link.
3. Each family is joined by a signature tree: pages of sets with OR-combined
   bitmaps of their n-grams and ranges of their sizes, in order of their smallest n-gram.
   A dual traversal drops pairs of pages when their size ranges or
   their maximum possible overlap cannot reach the similarity, or when all their sets
   are in one class already; the pairs left are verified exactly.
4. A family above ``BLOCK_GRAMS`` n-grams is cut into blocks by hash: first each
   block is joined alone, then block 0 with the others, and last the sets
   outside the family's largest class with every block. Pairs within that
   class need no comparison, so a large group of copies costs no square of its size.

Scale: texts are read a few times and hashed with NumPy; only digests, the
first share of n-grams and the families' sets are shuffled. A task holds two
blocks at most. All is exact up to collisions of 64-bit hashes.

Defined results: null texts and texts without words have an empty set, link with
nothing and are their own class; repeated rows and equal texts link; the class id is
the smallest non-null id of the class; an empty table gives no rows; other
columns are ignored (``first_of_each`` keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.llm.frames import components, hash_filter, may_contain, release, small_batches
from tabprobe.llm.words import SPACE_WORDS, hashed_words, mix, shingles, slices
from tabprobe.session import cut_lineage

SLOT_BITS = 18  # table of document counts by n-gram slot
HOT_SHARE = 400
BLOCK_GRAMS = 1_000_000  # n-grams of a block: 8 MB
BITMAP_BYTES = 16 << 20  # bitmaps of a tree's sets
LEAF, FAN = 32, 8
_CLASS = np.uint64(0xA0761D6478BD642F)


def row_sets(arr: pa.Array, k: int):
    """(n-gram hashes sorted within each row, row bounds, class digest per row)."""
    _, _, _, bounds, h = hashed_words(arr, SPACE_WORDS)
    v, r = shingles(h, bounds, k)
    order = np.lexsort((v, r))
    v, r = v[order], r[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[new], r[new]
    n = np.bincount(r, minlength=len(arr))
    off = np.concatenate([[0], np.cumsum(n)])
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(v ^ _CLASS), dtype=np.uint64)])
    return v, off, mix(total[off[1:]] - total[off[:-1]] + n.astype(np.uint64))


def _slot(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _profile_task(schema, k):
    """One row per document (id, n, cls); at the task's end one row with the
    slots that many of its documents hold."""
    def run(batches):
        counts, docs, grams = np.zeros(1 << SLOT_BITS, np.int64), 0, 0
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                v, off, cls = row_sets(part.column("text"), k)
                counts += np.bincount(_slot(v), minlength=len(counts))
                docs += len(part)
                grams += len(v)
                m = len(part)
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(np.diff(off)), pa.array(cls.view(np.int64)), pa.nulls(m, pa.list_(pa.int32())),
                    pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.int64())], schema=schema)
        if docs:
            at = np.flatnonzero(counts >= max(8, (grams >> SLOT_BITS) + docs // (2 * HOT_SHARE)))
            yield pa.RecordBatch.from_arrays([
                pa.nulls(1, schema.field(0).type), pa.array([-1], pa.int64()), pa.array([0], pa.int64()),
                pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([counts[at]], pa.list_(pa.int64())),
                pa.array([docs], pa.int64())], schema=schema)
    return run


def prefix_length(n, num: int, den: int):
    """n-grams of a set of n that a linked set cannot all miss."""
    return n - -(-n * num // den) + 1


def _tokens_task(schema, k, num, den, share, hot, firsts: bool):
    """(tok, cls, d): with ``firsts`` the n-grams of the first share (d: prefix
    length less their number), else those that follow them in the prefix."""
    limit = np.uint64(int(share * 2**32))

    def run(batches):
        is_hot = np.unpackbits(hot.value, count=1 << SLOT_BITS).astype(bool)
        seen: set[int] = set()
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                v, off, cls = row_sets(batch.column("text").slice(lo, hi - lo), k)
                n = np.diff(off)
                use = np.zeros(len(n), bool)
                for i, c in enumerate(cls.tolist()):  # a class once per task
                    if n[i] and c not in seen:
                        seen.add(c)
                        use[i] = True
                row = np.repeat(np.arange(len(n)), n)
                level = np.where(is_hot[_slot(v)], 2, np.where((v & np.uint64(0xFFFFFFFF)) < limit, 0, 1))
                have = [np.bincount(row[level == x], minlength=len(n)) for x in range(3)]
                p = prefix_length(n, num, den)
                if firsts:
                    take = (level == 0) & use[row]
                else:
                    take = np.zeros(len(v), bool)
                    want = p - have[0]
                    for x in (1, 2):
                        mine = np.flatnonzero(level == x)
                        start = np.concatenate([[0], np.cumsum(have[x])])[row[mine]]
                        take[mine] = (np.arange(len(mine)) - start < want[row[mine]]) & use[row[mine]]
                        want = want - have[x]
                at = np.flatnonzero(take)
                for a in range(0, len(at), 200_000):
                    i = at[a:a + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(v[i].view(np.int64)), pa.array(cls[row[i]].view(np.int64)),
                                                      pa.array((p - have[0])[row[i]].astype(np.int32))], schema=schema)
    return run


def _sets_task(schema, k, wanted):
    """(cls, grams): the sets of classes that pass the filter, once per task."""
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                v, off, cls = row_sets(batch.column("text").slice(lo, hi - lo), k)
                ok = may_contain(wanted.value, cls) & (np.diff(off) > 0)
                out_c, out_v = [], []
                for i in np.flatnonzero(ok).tolist():
                    c = int(cls[i])
                    if c not in seen:
                        seen.add(c)
                        out_c.append(int(cls[i:i + 1].view(np.int64)[0]))
                        out_v.append(v[off[i]:off[i + 1]].tobytes())
                if out_c:
                    yield pa.RecordBatch.from_arrays([pa.array(out_c, pa.int64()), pa.array(out_v, pa.binary())], schema=schema)
    return run


# ------------------------------------------------------------ signature tree

class SignatureTree:
    """Sets in the order of their smallest n-gram, pages of LEAF sets, FAN pages
    a node; every node has an OR-combined bitmap and a range of sizes."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i]), i))
        self.sets = [sets[i] for i in self.order]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        m = len(sets)
        bits = 8
        while (1 << bits) < 16 * int(self.size.max()) and bits < 18 and m << (bits - 2) <= BITMAP_BYTES:
            bits += 1  # narrower bitmaps bound large sets less tightly, and lose no link
        words = 1 << (bits - 6)
        maps = np.zeros((m, words), np.uint64)
        for i, s in enumerate(self.sets):
            slot = s >> np.uint64(64 - bits)
            np.bitwise_or.at(maps[i], (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
        self.maps = maps
        # n-grams of a set that share a slot with another one of it
        self.slack = self.size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = []  # (first set, bitmap, smallest, largest, slack) of the nodes, leaves first
        step, src, lo, hi, sl = LEAF, maps, self.size, self.size, self.slack
        while True:
            at = np.arange(0, len(src), step)
            src = np.bitwise_or.reduceat(src, at, axis=0)
            lo, hi, sl = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sl, at)
            self.levels.append((src, lo, hi, sl))
            if len(at) == 1:
                break
            step = FAN

    def span(self, level: int, node: int) -> tuple[int, int]:
        width = LEAF * FAN ** level
        return node * width, min((node + 1) * width, len(self.sets))


def join_sets(sets: list[np.ndarray], num: int, den: int, label: np.ndarray | None = None, side: np.ndarray | None = None):
    """Links that connect the sets: (i, j) pairs forming a spanning forest of all
    links. ``label``: classes known before; ``side``: only pairs of different sides."""
    m = len(sets)
    if m < 2:
        return []
    tree = SignatureTree(sets)
    label = np.arange(m) if label is None else np.unique(label, return_inverse=True)[1][tree.order]
    label = label.copy()
    side = None if side is None else np.asarray(side)[tree.order]
    size, maps, slack = tree.size, tree.maps, tree.slack
    links = []
    top = len(tree.levels) - 1
    stack = [(top, 0, 0)]
    while stack:
        level, a, b = stack.pop()
        src, lo, hi, sl = tree.levels[level]
        (a0, a1), (b0, b1) = tree.span(level, a), tree.span(level, b)
        one = label[a0]
        if (label[a0:a1] == one).all() and (label[b0:b1] == one).all():
            continue
        if side is not None and (side[a0:a1] == side[a0]).all() and (side[b0:b1] == side[a0]).all():
            continue
        if a != b:
            if hi[a] * den < num * lo[b] or hi[b] * den < num * lo[a]:
                continue
            most = int(np.bitwise_count(src[a] & src[b]).sum(dtype=np.int64)) + int(min(sl[a], sl[b]))
            if most * (num + den) < num * (lo[a] + lo[b]):
                continue
        if level:
            below = len(tree.levels[level - 1][1])
            kids = lambda x: range(x * FAN, min((x + 1) * FAN, below))
            for x in kids(a):
                for y in kids(b):
                    if a != b or x <= y:
                        stack.append((level - 1, x, y))
            continue
        # two pages: bounds of all pairs, then exact overlaps of those left
        x = np.arange(a0, a1)
        both = np.zeros((a1 - a0, b1 - b0), np.int64)
        for w in range(0, maps.shape[1], 256):
            both += np.bitwise_count(maps[a0:a1, None, w:w + 256] & maps[None, b0:b1, w:w + 256]).sum(axis=2, dtype=np.int64)
        most = np.minimum(both + np.minimum(slack[a0:a1, None], slack[None, b0:b1]), np.minimum(size[a0:a1, None], size[None, b0:b1]))
        ok = most * (num + den) >= num * (size[a0:a1, None] + size[None, b0:b1])
        ok &= label[a0:a1, None] != label[None, b0:b1]
        if side is not None:
            ok &= side[a0:a1, None] != side[None, b0:b1]
        if a == b:
            ok &= x[:, None] < x[None, :]
        i, j = np.nonzero(ok)
        for k in np.argsort(-most[i, j] / (size[a0 + i] + size[b0 + j]), kind="stable"):
            p, q = a0 + int(i[k]), b0 + int(j[k])
            if label[p] == label[q]:
                continue
            s, t = tree.sets[p], tree.sets[q]
            if len(s) > len(t):
                s, t = t, s
            at = np.searchsorted(t, s)
            overlap = int((t[np.minimum(at, len(t) - 1)] == s).sum())
            if overlap * (num + den) >= num * (len(s) + len(t)):
                links.append((tree.order[p], tree.order[q]))
                label[label == label[q]] = label[p]
    return links


def _links_task(schema, num, den):
    """Joins the groups of rows with one key; rows come sorted by key."""
    def run(batches):
        key, cls, sets, label, side = None, [], [], [], []

        def done():
            if len(sets) > 1:
                two = side if len(set(side)) > 1 else None
                found = join_sets(sets, num, den, np.array(label), two)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([cls[i] for i, _ in found], pa.int64()),
                                                      pa.array([cls[j] for _, j in found], pa.int64())], schema=schema)
        for batch in batches:
            comp, blk, c, g, lab, sd = (batch.column(x) for x in ("comp", "task", "cls", "grams", "label", "side"))
            for i in range(batch.num_rows):
                here = (comp[i].as_py(), blk[i].as_py())
                if here != key:
                    yield from done()
                    key, cls, sets, label, side = here, [], [], [], []
                cls.append(c[i].as_py())
                sets.append(np.frombuffer(g[i].as_py(), np.uint64))
                label.append(lab[i].as_py())
                side.append(sd[i].as_py())
        yield from done()
    return run


def _join(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) found in the groups (comp, task) of rows cls, grams, label, side."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (rows.select("comp", "task", "cls", "grams", "label", "side").repartition(n, "comp", "task")
                 .sortWithinPartitions("comp", "task", "cls"))
    return dealt.mapInArrow(_links_task(schema, num, den), "a bigint, b bigint")


def _edges(prefix: DataFrame) -> DataFrame:
    """Every class linked to the smallest class that holds the n-gram."""
    low = prefix.groupBy("tok").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("tok", "lo")
    return prefix.join(low, "tok").where("cls <> lo").select(F.col("cls").alias("a"), F.col("lo").alias("b")).distinct()


def profile(docs: DataFrame, k: int, id_col: str, text_col: str):
    """(rows id, n, cls; bit-packed table of hot slots)."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    fields = f"id {dict(src.dtypes)['id']}, n bigint, cls bigint, slots array<int>, counts array<bigint>, docs bigint"
    out = cut_lineage(src.mapInArrow(_profile_task(to_arrow_schema(_parse_datatype_string(fields)), k), fields))
    total, grams = (x or 0 for x in out.agg(F.sum("docs"), F.sum(F.when(F.col("docs").isNull(), F.col("n")))).first())
    # what a slot holds beyond an even share of all n-grams tells a hot one, so long texts alone make none; at most 2**SLOT_BITS rows
    hot = (out.where("docs IS NOT NULL").select(F.explode(F.arrays_zip("slots", "counts")).alias("z"))
              .groupBy("z.slots").agg(F.sum("z.counts").alias("c")).where(F.col("c") >= max(64, (grams >> SLOT_BITS) + total // HOT_SHARE)).collect())
    table = np.zeros(1 << SLOT_BITS, np.uint8)
    table[[r["slots"] for r in hot]] = 1
    return out.where("docs IS NULL").select("id", "n", "cls"), np.packbits(table)


def links(docs: DataFrame, rows: DataFrame, hot: np.ndarray, k: int, num: int, den: int, text_col: str,
          block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(a, b): links between classes that connect all linked ones."""
    spark = docs.sparkSession
    src = docs.select(F.col(text_col).cast("string").alias("text"))
    share = min(1.0, max(0.05, (3.0 if 100 * num >= 85 * den else 1.7) * (1 - num / den)))
    shared_hot = spark.sparkContext.broadcast(hot)  # 2**SLOT_BITS bits
    schema = pa.schema([("tok", pa.int64()), ("cls", pa.int64()), ("d", pa.int32())])
    fields = "tok bigint, cls bigint, d int"

    def task(firsts):
        return src.mapInArrow(_tokens_task(schema, k, num, den, share, shared_hot, firsts), fields)
    w = Window.partitionBy("tok")
    met = (task(True).withColumns({"df": F.count("cls").over(w), "lo": F.min("cls").over(w), "hi": F.max("cls").over(w)})
                     .where("lo <> hi").select("tok", "cls", "d", "df"))
    of = Window.partitionBy("cls")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = (met.repartition(n, "cls").dropDuplicates(["cls", "tok"])
                 .withColumns({"c": F.count("tok").over(of), "r": F.row_number().over(of.orderBy("df", "tok"))})
                 .where("r <= d + c").select("tok", "cls"))
    prefix = cut_lineage(firsts.unionAll(task(False).select("tok", "cls")))
    del met, firsts
    release(spark)
    family = components(_edges(prefix))
    del prefix
    sizes = rows.groupBy("cls").agg(F.max("n").alias("n"))
    family = family.withColumnsRenamed({"node": "cls", "component": "comp"}).join(sizes, "cls")
    total = family.groupBy("comp").agg(F.ceil(F.sum("n") / F.lit(block_grams)).alias("nb"))
    family = cut_lineage(family.join(total, "comp").withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("nb"))))

    wanted = spark.sparkContext.broadcast(hash_filter(family, "cls"))
    sschema = pa.schema([("cls", pa.int64()), ("grams", pa.binary())])
    sets = (src.mapInArrow(_sets_task(sschema, k, wanted), "cls bigint, grams binary").join(family, "cls")
               .dropDuplicates(["cls"]))
    sets = cut_lineage(sets)
    release(spark)
    one = sets.withColumns({"task": F.col("blk"), "label": F.col("cls"), "side": F.lit(0)})
    found = cut_lineage(_join(one, num, den))
    many = sets.where("nb > 1")
    if many.isEmpty():
        return found

    def labelled(edges):
        cc = components(edges)
        return many.join(cc.withColumnsRenamed({"node": "cls", "component": "root"}), "cls", "left").withColumn(
            "label", F.coalesce("root", "cls")).drop("root")
    # block 0 with every other block
    now = labelled(found)
    first = now.where("blk = 0").withColumn("task", F.explode(F.sequence(F.lit(1).cast("long"), F.col("nb") - 1))).withColumn("side", F.lit(0))
    other = now.where("blk > 0").withColumns({"task": F.col("blk"), "side": F.lit(1)})
    found = cut_lineage(found.unionAll(_join(first.unionByName(other), num, den)))
    # the sets outside a family's largest class with every block
    now = cut_lineage(labelled(found))
    largest = (now.groupBy("comp", "label").count().groupBy("comp").agg(F.max_by("label", F.struct("count", "label")).alias("main")))
    outside = now.join(largest, "comp").where("label <> main").drop("main")
    parts = outside.groupBy("comp").agg(F.ceil(F.sum("n") / F.lit(block_grams)).alias("np"))
    outside = outside.join(parts, "comp").withColumn("part", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("np")))
    left = (outside.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
                   .withColumns({"task": F.col("part") * F.col("nb") + F.col("b"), "side": F.lit(0)}).drop("b", "part", "np"))
    right = (now.join(parts, "comp").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("np") - 1)))
                .withColumns({"task": F.col("part") * F.col("nb") + F.col("blk"), "side": F.lit(1)}).drop("part", "np"))
    return cut_lineage(found.unionAll(_join(left.unionByName(right), num, den)))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id",
                    text_col: str = "text", block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """Per row: id, n_shingles, cls (digest of its set) and component_id."""
    rows, hot = profile(docs, k, id_col, text_col)
    found = links(docs, rows, hot, k, num, den, text_col, block_grams)
    release(docs.sparkSession)
    cc = components(found).withColumnsRenamed({"node": "cls", "component": "root"})
    rows = rows.join(cc, "cls", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "cls")))
    low = rows.where("n > 0").groupBy("root").agg(F.min("id").alias("low"))
    out = rows.join(low, "root", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "cls",
                      F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("id")).alias("component_id"))


def first_of_each(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row of every class, all columns kept: the one with the smallest id (of
    equal ids the smallest text digest); all rows with an empty set stay."""
    some = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    i, t = F.col(id_col), F.col(text_col)
    keyed = docs.withColumns({"_k1": F.xxhash64(i, t), "_k2": F.when(some, F.xxhash64(t, F.lit(2), i)).otherwise(F.monotonically_increasing_id())})
    judged = near_duplicates(docs.where(some).select(F.struct(
        i.isNull().alias("z"), i.alias("i"), F.xxhash64(i, t).alias("k1"), F.xxhash64(t, F.lit(2), i).alias("k2")).alias("id"), t.alias("text")),
        k, num, den, "id", "text")
    gone = judged.where("NOT (id <=> component_id)").select(F.col("id.k1").alias("_k1"), F.col("id.k2").alias("_k2")).distinct()
    # the join and the removal of rows that repeat id and text share one exchange
    return keyed.join(gone, ["_k1", "_k2"], "left_anti").dropDuplicates(["_k1", "_k2"]).drop("_k1", "_k2")
