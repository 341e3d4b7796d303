"""Harmonic packing of documents into fixed-length sequences.

The reciprocal-capacity classes are 1, 1/2, 1/4, ... of the capacity: a piece
of class ``j`` holds ``2**j`` ids and a bin of that class holds exactly
``capacity / 2**j`` pieces, so every closed bin is full. A document is cut into
whole sequences and the binary parts of its remainder (largest first), which
puts each id into one piece and leaves nothing to pad. Each task fills its own
bins: a bin's fixed document count says when it closes, so workers need no
exchange. A task's last open bin of a class is closed as sequences of a power
of two pieces, whose lengths are powers of two and are not padded either.

Scale: one pass, no shuffle; a task holds the open bins only (under two
capacities of pieces per class). Sequence ids carry the partition number, so
they are unique over the job and the same when a task runs again.

Defined results: null text is empty (its end id alone is packed); repeated rows
(also of one doc_id) are packed one by one; an empty table gives no piece;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.frames import small_batches
from tabprobe.llm.words import slices

CAPACITY = 2048
END_ID = 1
_PARTITION_SHIFT = 40


def _cut(lengths: np.ndarray, capacity: int):
    """(document, start, size) of the pieces, in document order."""
    top = int(capacity).bit_length() - 1
    whole = lengths >> top
    bits = (lengths[:, None] >> np.arange(top - 1, -1, -1)) & 1
    sizes = np.concatenate([whole[:, None], bits], axis=1)
    doc, col = np.nonzero(sizes)
    n = sizes[doc, col]
    doc, col = np.repeat(doc, n), np.repeat(col, n)
    size = np.int64(1) << (top - col)
    first = np.searchsorted(doc, doc, side="left")
    done = np.cumsum(size) - size
    return doc, done - done[first], size


class _Bins:
    """The open bins of one task."""

    def __init__(self, capacity: int, partition: int):
        self.capacity, self.base = capacity, partition << _PARTITION_SHIFT
        self.top = capacity.bit_length() - 1
        self.seen = np.zeros(self.top + 1, np.int64)
        self.open: pa.Table | None = None

    def add(self, pieces: pa.Table) -> pa.Table:
        """Give pieces their place; return those of closed bins, keep the others."""
        size = pieces["length"].to_numpy()
        level = np.log2(size).astype(np.int64)
        ordinal = np.empty(len(size), np.int64)
        for j in np.unique(level):
            at = np.flatnonzero(level == j)
            ordinal[at] = self.seen[j] + np.arange(len(at))
            self.seen[j] += len(at)
        table = pieces.append_column("ordinal", pa.array(ordinal))
        if self.open is not None:
            table = pa.concat_tables([self.open, table])
        return self._place(table, False)

    def _place(self, table: pa.Table, last: bool) -> pa.Table:
        size = table["length"].to_numpy()
        level = np.log2(size).astype(np.int64)
        ordinal = table["ordinal"].to_numpy()
        per_bin = np.int64(1) << (self.top - level)
        number, index = ordinal // per_bin, ordinal % per_bin
        part = np.zeros(len(size), np.int64)
        if last:  # m pieces are closed as the binary parts of m
            m = self.seen[level] - number * per_bin
            at = index.copy()
            for b in range(self.top, -1, -1):
                has = (m >> b) & 1 == 1
                before = np.where(has, (m >> (b + 1)) << (b + 1), 0)
                here = has & (at >= before) & (at < before + (np.int64(1) << b))
                part[here] = b + 1
                index[here] = at[here] - before[here]
        sequence = self.base + (number * (self.top + 1) + level) * (self.top + 2) + part  # a bin closed in parts needs that many ids
        out = table.drop_columns(["ordinal"]).append_column("sequence_id", pa.array(sequence)).append_column(
            "offset", pa.array(index * size))
        if last:
            return out
        closed = number < (self.seen // (np.int64(1) << (self.top - np.arange(self.top + 1))))[level]
        self.open = table.filter(pa.array(~closed))
        return out.filter(pa.array(closed))

    def close(self) -> pa.Table | None:
        return self._place(self.open, True) if self.open is not None and len(self.open) else None


def _task(id_col, ranks_path, pattern, capacity, end_id, schema):
    def run(batches):
        from pyspark import TaskContext

        from tabprobe.llm.bpe import encoder
        enc = encoder(ranks_path, pattern)
        ctx = TaskContext.get()
        bins = _Bins(capacity, ctx.partitionId() if ctx else 0)
        names = schema.names

        def batches_of(table):
            yield from table.select(names).cast(schema).to_batches(max_chunksize=20_000)

        for batch in batches:
            for lo, hi in slices(batch.column("text"), 2 << 20):
                part = batch.slice(lo, hi - lo)
                ids, n = enc.encode(part.column("text").fill_null("").to_pylist())
                n = n + 1
                ends = np.cumsum(n)
                all_ids = np.full(int(ends[-1]), end_id, dtype="<u4")
                body = np.ones(len(all_ids), bool)
                body[ends - 1] = False
                all_ids[body] = ids
                doc, start, size = _cut(n, capacity)
                bounds = np.concatenate([[0], np.cumsum(size)]) * 4
                if bounds[-1] < 2**31:
                    packed = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(all_ids)])
                else:
                    packed = pa.array([all_ids[a // 4:b // 4].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.large_binary())
                pieces = pa.table({
                    "doc_id": part.column(id_col).take(pa.array(doc)), "start": start, "length": size,
                    "ids": packed, "doc_tokens": n[doc]})
                yield from batches_of(bins.add(pieces))
        rest = bins.close()
        if rest is not None:
            yield from batches_of(rest)
    return run


def pack(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: doc_id, start (ids of the document before the
    piece), length, ids (little-endian unsigned 32-bit), doc_tokens (with the
    end id), sequence_id, offset (in its sequence).

    ``ranks_path``: a byte-level BPE vocabulary as ranks, ``pattern`` its
    pre-tokenization rule; every worker reads the file at that path.
    ``capacity`` must be a power of two."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(src.dtypes)["doc_id"]
    fields = (f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, "
              "sequence_id bigint, offset bigint")
    from pyspark.sql.types import _parse_datatype_string
    schema = to_arrow_schema(_parse_datatype_string(fields))
    return src.mapInArrow(_task("doc_id", ranks_path, pattern, capacity, end_id, schema), fields)
