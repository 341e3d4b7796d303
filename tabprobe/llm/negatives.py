"""Hard-negative mining with an STR-packed R-tree.

Rows are packed sort-tile-recursively: sorted by length, label and the widest
coordinate into slabs (a range shuffle), each slab by the second widest one into tiles of
``TILE_ROWS`` rows, and each tile, by its own two widest coordinates at a time, into
nodes down to ``LEAF`` rows. A node stores its minimum bounding box, which bounds
every inner product with a query coordinate by coordinate: between the sums of the
smaller and of the larger of ``q_i low_i`` and ``q_i high_i``.

A search looks for the k best scores within one or more score windows, among rows
of the query's label (positives) or of other labels (negatives). Its best-first queue visits nodes by
upper bound and drops a node when its interval misses every window that still wants it: outside
the window, or strictly below its k-th best score. The same bounds lead across tiles: a search
first asks its most promising tile, then all others that its k-th scores leave open.

Scale: tiles are packed and written once. A task holds a tile (or a block of ``DIRECTORY`` tile boxes) and
searches are streamed through it. Equal vectors of a label are one entry with their k + 1
smallest ids (no other can be among the k best), equal anchors are searched once.

Defined results: rows without an id, label or vector and empty vectors take no part; vectors meet only those of their
own length; rows that repeat id, label and vector are one; an anchor id with several labels or vectors
counts with each of them, and rows with its id are never its positives or negatives; ties go to the smaller id; fewer
rows than asked give all of them; an anchor without positives gives no rows; an empty table
gives no rows; other columns are ignored. Scores are exact 64-bit integers; components so
large that a score could exceed them raise an error.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.llm.pages import bytes_matrix, serve
from tabprobe.session import cut_lineage

TILE_ROWS = 8192
LEAF = 512
FAN = 16  # children of a node at most
DIRECTORY = 1024  # tile boxes looked at by one task
SAMPLE_ROWS = 4096  # rows whose spread chooses the two coordinates of the slabs
_FAR = (1 << 63) - 1


# ------------------------------------------------------------------ R-tree of a tile

class Tree:
    """Nodes as arrays: boxes low and high, first child or row, number of children or rows (negative: leaf).
    ``order`` names the rows in leaf order."""

    def __init__(self, vectors: np.ndarray):
        self.low, self.high, self.first, self.count = [], [], [], []
        self.order = np.zeros(0, np.int64)
        parts: list[np.ndarray] = []
        todo = [(np.arange(len(vectors)), self._node(vectors))]
        done = 0
        while todo:  # breadth first, so the children of a node are neighbours
            later = []
            for rows, at in todo:
                if len(rows) <= LEAF:
                    self.first[at], self.count[at] = done, -len(rows)
                    parts.append(rows)
                    done += len(rows)
                    continue
                tiles = self._tiles(vectors, rows)
                self.first[at], self.count[at] = len(self.low), len(tiles)
                later += [(t, self._node(vectors[t])) for t in tiles]
            todo = later
        self.order = np.concatenate(parts)
        self.low, self.high = np.stack(self.low), np.stack(self.high)
        self.first, self.count = np.array(self.first), np.array(self.count)

    def _node(self, v: np.ndarray) -> int:
        self.low.append(v.min(axis=0))
        self.high.append(v.max(axis=0))
        self.first.append(0)
        self.count.append(0)
        return len(self.low) - 1

    @staticmethod
    def _tiles(vectors, rows):
        """Slabs by the widest coordinate, tiles by the second widest."""
        wide = np.argsort(-(vectors[rows].max(axis=0) - vectors[rows].min(axis=0)).astype(float), kind="stable")
        parts = min(FAN, -(-len(rows) // LEAF))
        slabs = int(np.ceil(parts ** 0.5))
        tiles = []
        for slab in np.array_split(rows[np.argsort(vectors[rows, wide[0]], kind="stable")], slabs):
            axis = wide[min(1, len(wide) - 1)]
            tiles += [t for t in np.array_split(slab[np.argsort(vectors[slab, axis], kind="stable")], -(-parts // slabs)) if len(t)]
        return tiles


def interval(low: np.ndarray, high: np.ndarray, q: np.ndarray):
    """Bounds of the inner products of a query with what lies in boxes, rounded outwards."""
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    low, high = low.astype(np.float64, copy=False), high.astype(np.float64, copy=False)
    least, most = low @ up + high @ down, high @ up + low @ down
    if max(np.abs(least).max(initial=0), np.abs(most).max(initial=0)) >= 2.0 ** 62:
        raise ArithmeticError("components are too large: an inner product could exceed 64 bits")
    return np.floor(least - 1e-9 * (1 + np.abs(least))), np.ceil(most + 1e-9 * (1 + np.abs(most)))


class Windows:
    """k best (score, id) in each of several score windows."""

    def __init__(self, low, high, floor, k: int):
        self.low, self.high, self.k = np.array(low, np.int64), np.array(high, np.int64), k
        self.floor = np.maximum(self.low, np.array(floor, np.int64))  # scores strictly below are of no use
        self.best: list[list[tuple[int, int]]] = [[] for _ in low]  # (-score, id), best first

    def wants(self, least, most):
        """True for intervals that some window still wants."""
        return ((most[..., None] >= self.floor) & (least[..., None] <= self.high) & (self.floor <= self.high)).any(axis=-1)

    def add(self, scores: np.ndarray, rows: np.ndarray, entry_ids):
        fits = (scores[None, :] >= self.floor[:, None]) & (scores[None, :] <= self.high[:, None])
        for w in np.flatnonzero(fits.any(axis=1)):
            at = np.flatnonzero(fits[w])
            if len(at) > self.k:  # entries tied with the k-th stay: an id among theirs may be smaller
                at = at[scores[at] >= np.partition(scores[at], -self.k)[-self.k]]
            new = self.best[w] + [(-s, name) for s, row in zip(scores[at].tolist(), rows[at].tolist()) for name in entry_ids(row)]
            new.sort()
            self.best[w] = new[:self.k]
            if len(self.best[w]) == self.k:
                self.floor[w] = max(self.floor[w], -self.best[w][-1][0])


def search(tile: "Tile", q: np.ndarray, label: int, same: bool, win: Windows) -> int:
    """Best-first search of one tile; returns the number of leaves read."""
    tree = tile.tree
    tile.check(q)
    vectors, query = (tile.floats, q.astype(np.float64)) if tile.exact(q) else (tile.vectors, q)
    least, most = interval(tree.low[:1], tree.high[:1], q)
    queue = [(-most[0], 0, least[0])]
    leaves = 0
    while queue:
        most, node, least = heapq.heappop(queue)
        if not win.wants(np.array(least), np.array(-most)):
            continue
        first, count = int(tree.first[node]), int(tree.count[node])
        if count < 0:
            leaves += 1
            rows = np.flatnonzero((tile.label[first:first - count] == label) == same)
            if len(rows):
                win.add((vectors[first:first - count] @ query)[rows].astype(np.int64), rows + first, tile.entry_ids)
            continue
        kids = np.arange(first, first + count)
        a, b = interval(tree.low[kids], tree.high[kids], q)
        for i in np.flatnonzero(win.wants(a, b)):
            heapq.heappush(queue, (-b[i], int(kids[i]), a[i]))
    return leaves


class Tile:
    """Rows of a tile in leaf order with their tree; picklable."""

    def __init__(self, vectors: np.ndarray, label: np.ndarray, ids: list[list[int]]):
        self.tree = Tree(vectors)
        order = self.tree.order
        self.tree.order = None
        self.vectors, self.label = vectors[order], label[order]
        self.ids = np.concatenate([np.array(ids[i], np.int64) for i in order])
        self.start = np.concatenate([[0], np.cumsum([len(ids[i]) for i in order])])
        self.top = int(np.abs(self.vectors.astype(np.float64)).max(initial=0))
        if self.top < 1 << 31:
            self.vectors = self.vectors.astype(np.int32)

    def opened(self) -> "Tile":
        self.tree.low, self.tree.high = self.tree.low.astype(np.float64), self.tree.high.astype(np.float64)
        self.floats = self.vectors.astype(np.float64)
        self.vectors = self.vectors.astype(np.int64)
        return self

    def entry_ids(self, row: int) -> list[int]:
        return self.ids[self.start[row]:self.start[row + 1]].tolist()

    def _most(self, q: np.ndarray) -> float:
        return float(self.top) * float(np.abs(q.astype(np.float64)).max(initial=0)) * len(q)

    def exact(self, q: np.ndarray) -> bool:
        """True if doubles hold every inner product exactly."""
        return self._most(q) < 2.0 ** 52

    def check(self, q: np.ndarray) -> None:
        if self._most(q) >= 2.0 ** 62:
            raise ArithmeticError("components are too large: an inner product could exceed 64 bits")


# ------------------------------------------------------------------ packing

_TILE = [("tile", pa.int64()), ("d", pa.int32()), ("label_low", pa.int64()), ("label_high", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("body", pa.binary())]
_TILE_DDL = "tile bigint, d int, label_low bigint, label_high bigint, low binary, high binary, body binary"


def _pack_task(tile_rows):
    schema = pa.schema(_TILE)

    def run(batches):
        from pyspark import TaskContext
        here, made = TaskContext.get().partitionId(), 0
        vectors, labels, ids = [], [], []

        def done():
            nonlocal made
            v, lab = np.array(vectors, np.int64), np.array(labels, np.int64)
            tile = Tile(v, lab, ids)
            row = ((here << 32) + made, v.shape[1], int(lab.min()), int(lab.max()), v.min(axis=0).tobytes(), v.max(axis=0).tobytes(), pickle.dumps(tile, 5))
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, (_, kind) in zip(row, _TILE)], schema=schema)
        for batch in batches:
            for v, lab, i in zip(batch.column("v"), batch.column("label").to_pylist(), batch.column("ids").to_pylist()):
                v = v.values.to_numpy()
                if vectors and (len(vectors) >= tile_rows or len(v) != len(vectors[0])):
                    yield done()
                    vectors, labels, ids = [], [], []
                vectors.append(v)
                labels.append(lab)
                ids.append(i)
        if vectors:
            yield done()
    return run


def pack(entries: DataFrame, tile_rows: int) -> DataFrame:
    """One row a tile of (label, v, ids) rows, written to the checkpoint folder."""
    n = entries.count()
    some = [r["v"] for r in entries.orderBy(F.xxhash64("label", "v"), "v").limit(SAMPLE_ROWS).select("v").collect()]
    width = max((len(v) for v in some), default=1)
    spread = np.array([np.var([float(v[i]) for v in some if len(v) > i]) for i in range(width)])
    axis = np.argsort(-spread, kind="stable")
    first, second = (F.get("v", F.lit(int(axis[min(i, len(axis) - 1)]))) for i in range(2))
    slabs = max(1, round((n / tile_rows) ** 0.5))
    rows = entries.withColumns({"d": F.size("v"), "x": first, "y": second, "h": F.xxhash64("v")})
    dealt = rows.repartitionByRange(slabs, "d", "label", "x", "h").sortWithinPartitions("d", "y", "h")
    return cut_lineage(dealt.select("label", "v", "ids").mapInArrow(_pack_task(tile_rows), _TILE_DDL))


# ------------------------------------------------------------------ searches over all tiles

class _Directory:
    def __init__(self, rows: pa.Table):
        self.tile = rows["tile"].to_numpy()
        self.from_label, self.to_label = rows["label_low"].to_numpy(), rows["label_high"].to_numpy()
        d = rows["d"][0].as_py()
        self.low, self.high = bytes_matrix(rows["low"], np.int64, d), bytes_matrix(rows["high"], np.int64, d)


_ASK = [("tile", pa.int64()), ("bound", pa.float64()), ("sid", pa.int64()), ("slabel", pa.int64()), ("sv", pa.binary()), ("w_low", pa.list_(pa.int64())),
        ("w_high", pa.list_(pa.int64())), ("w_floor", pa.list_(pa.int64()))]
_ASK_DDL = "tile bigint, bound double, sid bigint, slabel bigint, sv binary, w_low array<bigint>, w_high array<bigint>, w_floor array<bigint>"


def _route(same: bool, first: bool, k: int):
    """The tiles that a search wants: with ``first`` its most promising one of the block, else all
    that its floors leave open but the one already visited."""
    schema = pa.schema(_ASK)

    def run(page, batch):
        label, been = batch.column("slabel").to_numpy(), batch.column("visited").to_pylist()
        out_row, out_tile, out_bound = [], [], []
        for i in range(len(batch)):
            q = np.frombuffer(batch.column("sv")[i].as_py(), np.int64)
            least, most = interval(page.low, page.high, q)
            win = Windows(*(batch.column(c)[i].as_py() for c in ("w_low", "w_high", "w_floor")), k)
            ok = win.wants(least, most)
            if same:
                ok &= (page.from_label <= label[i]) & (label[i] <= page.to_label)
            else:
                ok &= (page.from_label != label[i]) | (label[i] != page.to_label)
            if been[i] is not None:
                ok &= page.tile != been[i]
            at = np.flatnonzero(ok)
            bound = np.minimum(most[at], float(win.high.max()))
            if first and len(at):
                best = np.lexsort((page.tile[at], -bound))[:1]
                at, bound = at[best], bound[best]
            out_row += [i] * len(at)
            out_tile += page.tile[at].tolist()
            out_bound += bound.tolist()
        take = pa.array(out_row, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(out_tile, pa.int64()), pa.array(out_bound, pa.float64()),
                                          *[batch.column(c).take(take) for c, _ in _ASK[2:]]], schema=schema)
    return run


def _visit(same: bool, k: int):
    schema = pa.schema([("sid", pa.int64()), ("w", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(tile, batch):
        out = []
        for sid, label, v, low, high, floor in zip(*(batch.column(c).to_pylist() for c in ("sid", "slabel", "sv", "w_low", "w_high", "w_floor"))):
            win = Windows(low, high, floor, k)
            search(tile, np.frombuffer(v, np.int64), label, same, win)
            out += [(sid, w, i, -s) for w, best in enumerate(win.best) for s, i in best]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
    return run


def find(tiles: DataFrame, searches: DataFrame, same: bool, k: int) -> DataFrame:
    """(sid, w, vec_id, score): the k best of every window of every search. ``searches``: sid, d, slabel, sv (bytes),
    w_low, w_high (arrays, inclusive windows)."""
    blocks = max(1, -(-tiles.count() // DIRECTORY))
    boxes = tiles.drop("body").withColumn("block", F.pmod(F.xxhash64("tile"), F.lit(blocks)))
    floors = searches.withColumns({"w_floor": F.col("w_low"), "visited": F.lit(None).cast("long")})
    best = Window.partitionBy("sid", "w").orderBy(F.col("score").desc(), "vec_id")
    found = None
    for first in (True, False):
        # every search meets every block of boxes: a stated query set against all tiles
        asked = floors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        wanted = serve(boxes, asked, ["block", "d"], _Directory, _route(same, first, k), _ASK_DDL)
        if first:
            w = Window.partitionBy("sid").orderBy(F.col("bound").desc(), "tile")
            wanted = wanted.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
        wanted = cut_lineage(wanted.drop("bound"))
        got = serve(tiles.select("tile", "body"), wanted, ["tile"], lambda t: pickle.loads(t["body"][0].as_py()).opened(), _visit(same, k),
                    "sid bigint, w bigint, vec_id bigint, score bigint")
        found = got if found is None else found.unionAll(got)
        found = cut_lineage(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"))
        if first:  # floors of the windows that are full
            full = found.groupBy("sid", "w").agg(F.count("*").alias("c"), F.min("score").alias("f")).where(F.col("c") >= k)
            full = full.groupBy("sid").agg(F.map_from_entries(F.collect_list(F.struct("w", "f"))).alias("full"))
            floors = (searches.join(full, "sid", "left").join(wanted.select("sid", F.col("tile").alias("visited")), "sid", "left")
                              .withColumn("w_floor", F.expr("transform(w_low, (x, i) -> coalesce(full[cast(i AS bigint)], x))")).drop("full"))
            floors = cut_lineage(floors)
    return found


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   tile_rows: int = TILE_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``rows``: vec_id, label, v (array<bigint>); ``anchors``: those
    of them that negatives are mined for, same columns. A negative's score lies between ``low`` and ``high`` percent of the positive's."""
    spark = rows.sparkSession
    k = max(positives, negatives) + 1
    clean = lambda df: (df.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(v) > 0")
                          .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v").distinct())
    of = Window.partitionBy("label", "v").orderBy("vec_id")
    entries = cut_lineage(clean(rows).withColumn("r", F.row_number().over(of)).where(F.col("r") <= k)
                          .groupBy("label", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))  # at most k ids
    own = cut_lineage(clean(anchors))
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if entries.isEmpty() or own.isEmpty():
        return spark.createDataFrame([], out)
    tiles = pack(entries, tile_rows)
    distinct = cut_lineage(own.select("label", "v").distinct().withColumn("sid", F.monotonically_increasing_id()))
    coded = distinct.mapInArrow(_bytes_task, "sid bigint, d int, slabel bigint, sv binary")
    coded = cut_lineage(coded)
    every = coded.withColumns({"w_low": F.array(F.lit(-_FAR)), "w_high": F.array(F.lit(_FAR))})
    near = find(tiles, every, True, positives + 1).select("sid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    by_anchor = Window.partitionBy("anchor_id", "label", "v").orderBy(F.col("positive_score").desc(), "positive_id")
    pairs = cut_lineage(own.withColumnRenamed("vec_id", "anchor_id").join(distinct, ["label", "v"]).join(near, "sid").where("positive_id <> anchor_id")
                           .withColumn("r", F.row_number().over(by_anchor)).where(F.col("r") <= positives)
                           .select("anchor_id", "sid", "positive_id", "positive_score"))
    # one window for every score of a positive
    scores = pairs.groupBy("sid").agg(F.sort_array(F.collect_set("positive_score")).alias("p"))  # at most positives + 1
    windows = (coded.join(scores, "sid")
                    .withColumns({"w_low": F.expr(f"transform(p, x -> -floor(cast(x AS decimal(20, 0)) * -{low} / 100))"),
                                  "w_high": F.expr(f"transform(p, x -> floor(cast(x AS decimal(20, 0)) * {high} / 100))")})
                    .withColumns({"w_low": F.col("w_low").cast("array<bigint>"), "w_high": F.col("w_high").cast("array<bigint>")}))
    hard = find(tiles, windows.drop("p"), False, negatives + 1)
    hard = (hard.join(windows.select("sid", F.posexplode("p").alias("w", "positive_score")), ["sid", "w"])
                .select("sid", "positive_score", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")))
    by_pair = Window.partitionBy("anchor_id", "sid", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return (pairs.join(hard, ["sid", "positive_score"]).where("negative_id <> anchor_id").withColumn("rank", F.row_number().over(by_pair))
                 .where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def _bytes_task(batches):
    schema = pa.schema([("sid", pa.int64()), ("d", pa.int32()), ("slabel", pa.int64()), ("sv", pa.binary())])
    for batch in batches:
        v = [x.values.to_numpy() for x in batch.column("v")]
        yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array([len(x) for x in v], pa.int32()), batch.column("label"),
                                          pa.array([x.tobytes() for x in v], pa.binary())], schema=schema)
