"""Benchmark decontamination by winnowing.

Texts become lower-cased words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``). From
every run of ``window - gram + 1`` consecutive ``gram``-word hashes the smallest
is kept (the leftmost of equal ones), so two texts that share ``window``
consecutive words always keep a common fingerprint at the same place of the
span: no shared span of ``window`` words is missed. Training and test fingerprints are joined, and each joined
hit is extended word by word, left and right, as far as a window that holds
the fingerprint can reach; hits whose run is shorter than ``window`` words are
dropped. Test items of fewer words than the window are fingerprinted by their whole
sequence.

Scale: one pass over the documents; only fingerprints that pass a fixed-size
filter of the benchmark's fingerprints (1 MiB) leave a task, with the few words
around them. The join is an ordinary Spark join (adaptive, so a hot passage is
split), and results are aggregated per document row.

Defined results: null or word-less texts have no words, hits or items, and are
not contaminated; repeated rows (also of one doc_id) are judged row by row;
benchmark rows without words are ignored, and equal items all count; a null
item_id marks words but is not listed. An empty benchmark marks nothing.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.frames import first_row_id, hash_filter, may_contain
from tabprobe.llm.words import (ALNUM_WORDS, gram_hashes, hashed_words, lowered, mix, slices)
from tabprobe.session import cut_lineage

WINDOW = 13
GRAM = 8

_HIT = "struct<fp:bigint,pos:bigint,off:int,words:array<string>>"


def _whole_hash(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words at each position, for items shorter than the window."""
    g = gram_hashes(h, n)[at] if len(h) >= n else np.zeros(0, np.uint64)
    return mix(g + np.uint64(0x5151 + n))


def _winnow(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the fingerprints of one text's word hashes."""
    g = gram_hashes(h, gram)
    w = window - gram + 1
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best = g[:n].copy()
    at = np.zeros(n, dtype=np.int64)
    for j in range(1, w):
        c = g[j:j + n]
        less = c < best
        best[less] = c[less]
        at[less] = j
    pos = np.unique(at + np.arange(n))
    return pos, g[pos]


def _fingerprints(h, window, gram, lengths, bitmap=None):
    """(positions, fingerprints, words before, words from there) of one text: the words
    around a fingerprint that its windows reach. ``lengths``: item lengths below
    the window that count too (their whole sequence)."""
    pos, fp = _winnow(h, window, gram)
    if bitmap is not None and len(fp):
        ok = may_contain(bitmap, fp)
        pos, fp = pos[ok], fp[ok]
    out = [(pos, fp, window - gram, window)]
    for n in lengths:
        at = np.arange(max(0, len(h) - n + 1))
        f = _whole_hash(h, at, n)
        if bitmap is not None and len(f):
            ok = may_contain(bitmap, f)
            at, f = at[ok], f[ok]
        out.append((at, f, 0, n))
    return out


def _documents_task(id_cols, text_col, schema, window, gram, lengths, shared):
    def run(batches):
        rid = first_row_id()
        bitmap = shared.value
        for batch in batches:
            for lo, hi in slices(batch.column(text_col)):
                part = batch.slice(lo, hi - lo)
                data, s, e, bounds, h = hashed_words(part.column(text_col), ALNUM_WORDS)
                counts = np.diff(bounds)
                hits: list[list] = []
                for r in range(len(counts)):
                    a, z = int(bounds[r]), int(bounds[r + 1])
                    mine = []
                    for pos, fp, back, ahead in _fingerprints(h[a:z], window, gram, lengths, bitmap):
                        for p, f in zip(pos.tolist(), fp.view(np.int64).tolist()):
                            i, j = max(0, p - back), min(z - a, p + ahead)
                            mine.append({"fp": f, "pos": p, "off": p - i,
                                         "words": [lowered(data, s[a + x], e[a + x]) for x in range(i, j)]})
                    hits.append(mine)
                cols = [pa.array(np.arange(rid, rid + len(counts))), *[part.column(c) for c in id_cols],
                        pa.array(counts.astype(np.int64)), pa.array(hits, type=schema.field("hits").type)]
                rid += len(counts)
                yield pa.RecordBatch.from_arrays(cols, schema=schema)
    return run


def _items_task(item_col, text_col, schema, window, gram):
    def run(batches):
        for batch in batches:
            data, s, e, bounds, h = hashed_words(batch.column(text_col), ALNUM_WORDS)
            rows = []
            for r, item in enumerate(batch.column(item_col)):
                a, z = int(bounds[r]), int(bounds[r + 1])
                n = z - a
                if n == 0:
                    continue
                words = [lowered(data, s[x], e[x]) for x in range(a, z)]
                if n < window:
                    f = _whole_hash(h[a:z], np.zeros(1, np.int64), n).view(np.int64)
                    rows.append((int(f[0]), item.as_py(), n, 0, words))
                    continue
                pos, fp = _winnow(h[a:z], window, gram)
                for p, f in zip(pos.tolist(), fp.view(np.int64).tolist()):
                    i, j = max(0, p - (window - gram)), min(n, p + window)
                    rows.append((f, item.as_py(), 0, p - i, words[i:j]))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, schema)], schema=schema)
    return run


def _extend_task(window):
    """Exact runs around joined fingerprints: (row_id, item, start, end)."""
    def run(frames):
        import pandas as pd
        for pdf in frames:
            out = []
            for rid, pos, off, words, item, n, ioff, iwords in pdf.itertuples(index=False):
                if n:  # a short item: its whole sequence must stand here
                    if list(words) == list(iwords):
                        out.append((rid, item, pos, pos + n))
                    continue
                left = 0
                while left < off and left < ioff and words[off - left - 1] == iwords[ioff - left - 1]:
                    left += 1
                right, most = 0, min(len(words) - off, len(iwords) - ioff)
                while right < most and words[off + right] == iwords[ioff + right]:
                    right += 1
                if left + right >= window:
                    out.append((rid, item, pos - left, pos + right))
            yield pd.DataFrame(out, columns=["row_id", "item", "start", "end"]).astype(
                {"row_id": "int64", "start": "int64", "end": "int64"})
    return run


def _arrow_schema(df: DataFrame, fields: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(fields))


def contamination(docs: DataFrame, benchmark: DataFrame, id_cols: tuple[str, ...] = ("doc_id",),
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document row: the id columns, ``n_words``, ``spans`` (merged,
    half-open word ranges inside occurring windows), ``n_hit`` (their words)
    and ``items`` (sorted distinct ids, as strings, of the occurring items)."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"),
                             F.col(item_text_col).alias("text"))
    ischema = "fp bigint, item string, n int, off int, words array<string>"
    arrow = _arrow_schema(items, ischema)
    prints = cut_lineage(items.mapInArrow(_items_task("item", "text", arrow, window, gram), ischema))
    # at most window - 1 different lengths
    lengths = sorted(r.n for r in prints.where("n > 0").select("n").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(hash_filter(prints, "fp"))

    names = [f"k{i}" for i in range(len(id_cols))]
    src = docs.select(*[F.col(c).alias(k) for c, k in zip(id_cols, names)], F.col(text_col).cast("string").alias("text"))
    types = dict(src.dtypes)
    dschema = ", ".join(["row_id bigint", *[f"{k} {types[k]}" for k in names], "n_words bigint", f"hits array<{_HIT}>"])
    arrow = _arrow_schema(src, dschema)
    rows = cut_lineage(src.mapInArrow(_documents_task(names, "text", arrow, window, gram, lengths, shared), dschema))

    hits = rows.select("row_id", F.explode("hits").alias("h")).select("row_id", "h.*")
    pairs = (hits.join(prints.select("fp", "item", "n", F.col("off").alias("ioff"), F.col("words").alias("iwords")), "fp")
                 .select("row_id", "pos", "off", "words", "item", "n", "ioff", "iwords"))
    runs = cut_lineage(pairs.mapInPandas(_extend_task(window), "row_id bigint, item string, start bigint, end bigint"))
    found = runs.groupBy("row_id", "start").agg(F.max("end").alias("end")).groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
    item_lists = (runs.where("item IS NOT NULL").select("row_id", "item").distinct().groupBy("row_id")
                      .agg(F.array_sort(F.collect_list("item")).alias("items")))
    # runs sorted by start: one that starts beyond the last one's end opens a new span
    empty = "CAST(array() AS array<struct<start:bigint,end:bigint>>)"
    merged = F.expr(f"""aggregate(s, {empty}, (acc, x) ->
        CASE WHEN size(acc) > 0 AND x.start <= element_at(acc, -1).end
             THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct(
                    'start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end))))
             ELSE concat(acc, array(named_struct('start', x.start, 'end', x.end))) END)""")
    found = found.select("row_id", merged.alias("spans"))
    out = rows.drop("hits").join(found, "row_id", "left").join(item_lists, "row_id", "left")
    return out.select(*[F.col(k).alias(c) for c, k in zip(id_cols, names)], "n_words",
                      F.coalesce("spans", F.expr(empty)).alias("spans"),
                      F.expr("coalesce(aggregate(spans, 0L, (acc, x) -> acc + x.end - x.start), 0L)").alias("n_hit"),
                      F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"))


def is_contaminated():
    """The decision on ``contamination`` rows: a hit, and at least 5 % of the words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def text_key(col: str = "text"):
    """128-bit key of a text; verdicts depend on the text alone."""
    return [F.xxhash64(F.lit("a"), F.col(col)), F.xxhash64(F.col(col), F.lit("b"))]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is not contaminated, all columns kept."""
    k1, k2 = text_key(text_col)
    texts = docs.select(k1.alias("_k1"), k2.alias("_k2"), F.col(text_col).alias("_text"))
    bad = (contamination(texts, benchmark, ("_k1", "_k2"), "_text").where(is_contaminated())
           .select("_k1", "_k2").distinct())
    return (docs.withColumns({"_k1": k1, "_k2": k2}).join(bad, ["_k1", "_k2"], "left_anti").drop("_k1", "_k2"))
