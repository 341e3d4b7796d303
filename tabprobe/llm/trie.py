"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns, held by every conversation that
starts with it; the root is the empty sequence. Conversations are sorted by their
sequence of turn digests, so the members of a node are neighbours.

1. Each task takes a range of that order. From the greatest depth down it merges the
   conversations that end at a depth with the nodes that survived from below,
   regroups them by the turns left, writes the nodes found there with their sums,
   and strips the last turn. Nodes are found and aggregated in this one pass.
2. Only nodes on the first or the last conversation's path can have members in
   another range. They leave the task as partial sums by node; ``FAN`` neighbouring
   ranges at a time are merged and peeled the same way, until one range is left.

Scale: one shuffle of 32 characters and one integer a turn to number the turns, one by
range. The range key ends with the conversation's id, so a sequence that very many
conversations share is split over tasks like any other. A task works in blocks of
``BLOCK_TURNS`` turns; partial sums number at most two paths a range. A conversation's
digests are held in one row; texts are not shuffled.

Defined results: rows without an id take no part; a null role or text is empty; turns come in
order of ``turn``, nulls first, of equal turns in order of their digest (MD5 of the length of the
role, the role and the text); repeated rows are turns each; a conversation without
turns is a member of the root only; an empty table gives no nodes; other columns are
ignored. Turns are told apart by their 128-bit digest.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.session import cut_lineage

DIGEST = 32  # characters of a turn's digest
BLOCK_TURNS = 1 << 19  # turns peeled at once: 16 MB of digests
CHUNK = 1 << 16  # ids of a row of ``ends``
FAN = 64  # ranges merged at once


class Trie(NamedTuple):
    """``nodes``: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved (sum over the subtree of a node's (n_convs - 1) times the characters of its last turn),
    ends (ids of the conversations that end there, ascending; null for nodes with a key),
    key (null but for nodes whose members lay in several ranges).
    ``ends``: key, seq, ids: the ends of the nodes with a key, ascending by seq and within ids."""

    nodes: DataFrame
    ends: DataFrame


def turn_digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, path, chars): each conversation's turn digests one after another, and the
    characters of each turn's text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.struct(F.col(turn_col).alias("t"), turn_digest(role, text).alias("d"), F.length(text).alias("n")).alias("z"))
    rows = rows.groupBy("id").agg(F.sort_array(F.collect_list("z")).alias("z"))
    return rows.select("id", F.array_join("z.d", "").alias("path"), F.col("z.n").alias("chars"))


# ------------------------------------------------------------------ one block

def _common(paths: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Turns that each sequence shares with the one before (0 for the first)."""
    out = np.zeros(len(size), np.int64)
    pair = np.arange(1, len(size))
    d = 0
    while len(pair):
        pair = pair[np.minimum(size[pair], size[pair - 1]) > d]
        pair = pair[(paths[at[pair] + d] == paths[at[pair - 1] + d]).all(axis=1)]
        d += 1
        out[pair] = d
    return out


def path_keys(path: str) -> list[bytes]:
    """A key for every prefix of a sequence, the empty one first."""
    h = hashlib.blake2b(digest_size=16)
    keys = [h.digest()]
    for i in range(0, len(path), DIGEST):
        h.update(path[i:i + DIGEST].encode())
        keys.append(h.digest())
    return keys


def peel(ids: np.ndarray, paths: list[str], chars: np.ndarray):
    """Peels sorted sequences. Returns (closed, partial, ends): closed nodes as columns;
    partial: rows (first, last, key, parent, depth, chars, n, low, kids, leaves, saved) of the nodes on the first
    and last sequence's path; ends: {key: ids} of those."""
    size = np.array([len(p) // DIGEST for p in paths], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])[:-1]
    flat = np.frombuffer("".join(paths).encode(), np.uint64).reshape(-1, DIGEST // 8)
    common = _common(flat, at, size)
    by_size = np.argsort(size, kind="stable")
    bounds = np.searchsorted(size[by_size], np.arange(int(size.max()) + 2))
    keys = path_keys(paths[0]), path_keys(paths[-1])
    last = len(size) - 1
    closed, partial, ends = [], [], {}
    # nodes that survive from below: first row, members, smallest member, leaves, saved, number (-1: partial)
    alive = [np.zeros(0, np.int64) for _ in range(6)]
    made = 0
    for d in range(int(size.max()), -1, -1):
        new = by_size[bounds[d]:bounds[d + 1]]  # conversations that end here
        k = len(new)
        row = np.concatenate([new, alive[0]])
        order = np.argsort(row, kind="stable")
        row = row[order]
        n, low, leaves, saved, number = (np.concatenate([x, y])[order] for x, y in zip(
            (np.ones(k, np.int64), ids[new], np.zeros(k, np.int64), np.zeros(k, np.int64), np.full(k, -2)), alive[1:]))
        head = common[row] < d
        head[0] = True
        first = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        start = row[first]
        ended = np.add.reduceat((number == -2).astype(np.int64), first)
        kids = np.add.reduceat((number >= 0).astype(np.int64), first)
        n, low = np.add.reduceat(n, first), np.minimum.reduceat(low, first)
        leaves, saved = np.add.reduceat(leaves, first), np.add.reduceat(saved, first)
        # which of them lie on the first or last sequence's path
        edge = np.zeros((2, len(first)), bool)
        edge[0, 0] = size[0] >= d and start[0] == 0
        if size[last] >= d:
            edge[1, -1] = True
        done = ~edge.any(axis=0)
        cost = chars[at[start] + d - 1].astype(np.int64) if d else np.zeros(len(first), np.int64)
        leaves[done & (kids == 0)] = 1
        saved[done] += ((n - 1) * cost)[done]
        numbers = np.full(len(first), -1)
        numbers[done] = made + np.arange(int(done.sum()))
        made += int(done.sum())
        # the parents of the nodes from below are known now
        if closed:
            mine = number >= 0
            closed[-1]["parent"] = np.where(done[group[mine]], low[group[mine]], np.int64(-1))
            closed[-1]["parent_key"] = [None if done[g] else keys[0 if edge[0, g] else 1][d] for g in group[mine].tolist()]
        closed.append({"low": low[done], "depth": np.full(int(done.sum()), d), "n": n[done], "kids": kids[done], "leaves": leaves[done],
                       "saved": saved[done], "start": start[done], "ended": ended[done]})
        for g in np.flatnonzero(~done).tolist():
            side = 0 if edge[0, g] else 1
            key = keys[side][d]
            partial.append((bool(edge[0, g]), bool(edge[1, g]), key, keys[side][d - 1] if d else None, d, int(cost[g]), int(n[g]),
                            int(low[g]), int(kids[g]), int(leaves[g]), int(saved[g])))
            if ended[g]:
                ends[key] = ids[start[g]:start[g] + ended[g]]
            leaves[g] = saved[g] = 0
        alive = [start, n, low, leaves, saved, numbers]
    closed[-1]["parent"], closed[-1]["parent_key"] = np.zeros(0, np.int64), []
    return closed, partial, ends


def merge(rows: list[tuple], final: bool):
    """Merges the partial sums of neighbouring ranges: rows (range, *partial). Returns
    (closed rows: key, low, depth, parent, parent_key, n, kids, leaves, saved; partial rows as given by ``peel``)."""
    lo, hi = min(r[0] for r in rows), max(r[0] for r in rows)
    nodes: dict[bytes, list] = {}
    for rng, first, last, key, parent, depth, chars, n, low, kids, leaves, saved in rows:
        x = nodes.get(key)
        if x is None:
            x = nodes[key] = [False, False, key, parent, depth, chars, 0, low, 0, 0, 0]
        x[0] |= first and rng == lo and not final
        x[1] |= last and rng == hi and not final
        x[6] += n
        x[7] = min(x[7], low)
        x[8] += kids
        x[9] += leaves
        x[10] += saved
    closed, partial = [], []
    for x in sorted(nodes.values(), key=lambda x: -x[4]):  # from the greatest depth down
        first, last, key, parent, depth, chars, n, low, kids, leaves, saved = x
        if first or last:
            partial.append(tuple(x))
            continue
        leaves, saved = leaves if kids else 1, saved + (n - 1) * chars
        up = nodes[parent] if depth else None
        if up:
            up[8] += 1
            up[9] += leaves
            up[10] += saved
        known = up is not None and not (up[0] or up[1])
        closed.append((key, low, depth, up[7] if known else None, None if known or not depth else parent, n, kids, leaves, saved))
    return closed, partial


# ------------------------------------------------------------------ tasks

_NODE = [("key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_key", pa.binary()),
         ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.list_(pa.int64()))]
_PART = [("range", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("pkey", pa.binary()), ("up", pa.binary()), ("pdepth", pa.int64()), ("chars", pa.int64()),
         ("n", pa.int64()), ("low", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()), ("psaved", pa.int64())]
_ENDS = [("ekey", pa.binary()), ("seq", pa.int64()), ("ids", pa.list_(pa.int64()))]
_SCHEMA = pa.schema(_NODE + _PART + _ENDS)  # a row holds a node, a partial sum or a chunk of ends
_SQL = {pa.binary(): "binary", pa.int64(): "bigint", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<bigint>"}
_DDL = ", ".join(f"`{f.name}` {_SQL[f.type]}" for f in _SCHEMA)


def _batch(n: int, cols: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([cols.get(f.name, None) if f.name in cols else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _rows_batch(fields, rows: list[tuple]) -> pa.RecordBatch:
    return _batch(len(rows), {name: pa.array(col, kind) for (name, kind), col in zip(fields, zip(*rows))})


def _closed_batches(closed, ids):
    for c in closed:
        n = len(c["low"])
        if not n:
            continue
        off = np.concatenate([[0], np.cumsum(c["ended"])])
        take = np.repeat(c["start"] - off[:-1], c["ended"]) + np.arange(off[-1])
        yield _batch(n, {
            "conv_id": pa.array(c["low"]), "depth": pa.array(c["depth"]), "n_convs": pa.array(c["n"]), "n_children": pa.array(c["kids"]),
            "parent_conv_id": pa.array(c["parent"], mask=np.array([k is not None for k in c["parent_key"]], bool)),
            "parent_key": pa.array(c["parent_key"], pa.binary()), "n_leaves": pa.array(c["leaves"]), "saved": pa.array(c["saved"]),
            "ends": pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids[take]))})


def _peel_task(block_turns):
    def run(batches):
        from pyspark import TaskContext
        here = TaskContext.get().partitionId()
        kept: list[tuple] = []
        blocks = 0
        ids, paths, chars, turns = [], [], [], 0

        def done():
            nonlocal blocks, kept
            mine = np.array(ids, np.int64)
            closed, partial, ends = peel(mine, paths, np.concatenate([*chars, [0]]).astype(np.int64))
            yield from _closed_batches(closed, mine)
            for key, some in ends.items():
                yield _rows_batch(_ENDS, [(key, (here << 38) + (blocks << 12) + i // CHUNK, some[i:i + CHUNK]) for i in range(0, len(some), CHUNK)])
            kept += [(blocks, *p) for p in partial]
            blocks += 1
            if blocks % FAN == 0:  # the blocks so far become one
                yield from fold()

        def fold():
            nonlocal kept
            closed, partial = merge(kept, False)
            if closed:
                yield _rows_batch(_NODE, [(*c, None) for c in closed])
            kept = [(blocks - 1, *p) for p in partial]
        for batch in batches:
            for i, p, c in zip(batch.column("id").to_pylist(), batch.column("path").to_pylist(), batch.column("chars")):
                ids.append(i)
                paths.append(p)
                chars.append(np.asarray(c.values))
                turns += 1 + len(p) // DIGEST
                if turns >= block_turns:
                    yield from done()
                    ids, paths, chars, turns = [], [], [], 0
        if ids:
            yield from done()
        if kept:
            yield from fold()
            yield _rows_batch(_PART, [(here, *p[1:]) for p in kept])
    return run


def _merge_task(final):
    names = [n for n, _ in _PART]

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(n).to_pylist() for n in names)))
        closed, partial = merge(rows, final)
        out = [_rows_batch(_NODE, [(*c, None) for c in closed])] if closed else []
        if partial:
            out.append(_rows_batch(_PART, [(rows[0][0] // FAN, *p) for p in partial]))
        return pa.Table.from_batches(out, schema=_SCHEMA)
    return run


def build(seqs: DataFrame, block_turns: int = BLOCK_TURNS) -> Trie:
    """The trie of (id, path, chars) rows, as given by ``sequences``."""
    spark = seqs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(seqs.select("id", "path", "chars")).repartitionByRange(n, "path", "id").sortWithinPartitions("path", "id")
    out = cut_lineage(dealt.mapInArrow(_peel_task(block_turns), _DDL))
    node = [f[0] for f in _NODE]
    nodes = out.where("depth IS NOT NULL").select(*node)
    ends = out.where("ekey IS NOT NULL").select(F.col("ekey").alias("key"), "seq", "ids")
    part = out.where("pdepth IS NOT NULL").select(*[f[0] for f in _PART])
    while True:
        n = -(-n // FAN)
        got = cut_lineage(part.groupBy(F.expr(f"`range` div {FAN}")).applyInArrow(_merge_task(n == 1), _DDL))
        nodes = nodes.unionAll(got.where("depth IS NOT NULL").select(*node))
        part = got.where("pdepth IS NOT NULL").select(*[f[0] for f in _PART])
        if n == 1:
            break
    # parents that lay in several ranges are known only now: at most two paths a range
    keyed = nodes.where("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_up"))
    open_ = nodes.where("parent_key IS NOT NULL").join(keyed, "parent_key").withColumn("parent_conv_id", F.col("_up"))
    cols = [c for c in node if c != "parent_key"]
    return Trie(nodes.where("parent_key IS NULL").select(*cols).unionAll(open_.select(*cols)), ends)


def trie(turns: DataFrame, **columns: str) -> Trie:
    """The prefix trie of a table of turns."""
    return build(sequences(turns, **columns))


# ------------------------------------------------------------------ digest of the ends

def _digest_task(batches):
    schema = pa.schema([("key", pa.binary()), ("sha", pa.string())])
    key, h = None, None
    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids")):
            text = ",".join(map(str, ids.values.to_pylist())).encode()
            if k == key:
                h.update(b"," + text)
                continue
            if key is not None:
                yield pa.RecordBatch.from_pydict({"key": [key], "sha": [h.hexdigest()]}, schema=schema)
            key, h = k, hashlib.sha256(text)
    if key is not None:
        yield pa.RecordBatch.from_pydict({"key": [key], "sha": [h.hexdigest()]}, schema=schema)


def with_ends_digest(t: Trie) -> DataFrame:
    """The nodes with ``ends_sha256``: SHA-256 of the comma-joined ids that end there. The ends of
    nodes that lay in several ranges are read in order, a chunk at a time."""
    n = int(t.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = t.ends.repartition(n, "key").sortWithinPartitions("key", "seq").mapInArrow(_digest_task, "key binary, sha string")
    mine = t.nodes.where("key IS NULL").withColumn("ends_sha256", F.sha2(F.array_join("ends", ","), 256))
    other = t.nodes.where("key IS NOT NULL").join(sums, "key", "left").withColumn("ends_sha256", F.coalesce("sha", F.sha2(F.lit(""), 256)))
    cols = [c for c in t.nodes.columns if c not in ("key", "ends")] + ["ends_sha256"]
    return mine.select(*cols).unionAll(other.select(*cols))
