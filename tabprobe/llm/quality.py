"""Quality classifier from weak labels.

Heuristic labellers vote good (+1), bad (-1) or nothing (0) on a text.
Expectation-maximisation over the counts of vote patterns estimates each
labeller's hit rates and the share of good texts, without any label. The
posterior of a pattern is the soft label of its texts, and a linear scorer over
hashed features (words, letter case and sign shapes, shape pairs, doubled words) is trained on
the soft labels of a bounded sample of rows; it judges every text.

Scale: votes and scores are row-wise; patterns are counted by Spark (at most
``3 ** labellers`` rows reach the driver, whatever the input); the scorer is
fitted on at most ``SAMPLE_ROWS`` texts chosen by hash, as feature counts.

Defined results: a null, empty or word-less text is rejected with score 0;
repeated rows get the same score; an empty table gives an empty result (no
model is fitted then); other columns pass through ``keep_good`` unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.frames import small_batches, with_text
from tabprobe.llm.words import SPACE_WORDS, find_words, hash_spans, mix, slices, text_buffers
from tabprobe.session import cut_lineage

SAMPLE_ROWS = 4000  # documented bound of the fitting sample, chosen by text hash
FEATURE_BITS = 15
KEEP_AT = 0.4
LABELLERS = ("signs_in_words", "upper_case", "separators", "sentences", "repeated_words", "function_words", "word_length", "line_repeats")

_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_HIGH = np.arange(256) >= 128
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = ~(_LOWER | _UPPER | _HIGH | _DIGIT)
_SIGN[[9, 10, 11, 12, 13, 32]] = False
_COMMON = np.zeros(256, bool)
_COMMON[[ord(x) for x in ".,;:'\"-()?"]] = True
_SHAPE = np.zeros(256, np.uint8)
for _k, _m in enumerate((_LOWER, _UPPER, _HIGH, _DIGIT, _SIGN & _COMMON, _SIGN & ~_COMMON)):
    _SHAPE[_m] = 1 << _k


class Texts:
    """Word-level facts of a chunk of texts."""

    def __init__(self, arr: pa.Array):
        self.data, self.off = text_buffers(arr)
        self.starts, self.ends, self.bounds = find_words(self.data, self.off, SPACE_WORDS)
        self.n = len(self.off) - 1
        self.words = np.diff(self.bounds)
        self.row = np.repeat(np.arange(self.n), self.words)

    def per_word(self, mask: np.ndarray) -> np.ndarray:
        """Bytes of a class in each word."""
        c = np.concatenate([[0], np.cumsum(mask[self.data])])
        return c[self.ends] - c[self.starts]

    def rate(self, flag: np.ndarray) -> np.ndarray:
        """Share of a text's words for which ``flag`` holds."""
        return np.bincount(self.row, flag, self.n) / np.maximum(self.words, 1)


def votes(t: Texts) -> np.ndarray:
    """(texts, labellers) of -1, 0, 1."""
    size = t.ends - t.starts
    odd, upper = t.per_word(_SIGN & ~_COMMON), t.per_word(_UPPER)
    letters = t.per_word(_LOWER | _UPPER | _HIGH)
    out = np.zeros((t.n, len(LABELLERS)), np.int8)

    def vote(k, value, bad_from, good_to, enough=5):
        out[:, k] = np.where(value >= bad_from, -1, np.where(value <= good_to, 1, 0)) * (t.words >= enough)

    vote(0, t.rate((odd > 0) & (letters > 0)), 0.3, 0.05)
    vote(1, t.rate((upper >= 2) & (upper == letters - t.per_word(_HIGH))), 0.5, 0.1)
    vote(2, t.rate((letters == 0) & (odd > 0)), 0.15, 0.02)
    # sentences: an end mark at a reasonable rate
    last = t.data[np.maximum(t.ends - 1, 0)] if len(t.ends) else np.zeros(0, np.uint8)
    marks = t.rate(np.isin(last, [ord("."), ord("?"), ord("!")]))
    out[:, 3] = np.where((marks > 0.5) | (marks < 0.005), -1, np.where((marks >= 0.02) & (marks <= 0.4), 1, 0)) * (t.words >= 20)
    # words that repeat in the text
    h = hash_spans(t.data, t.starts, t.ends) if len(t.starts) else np.zeros(0, np.uint64)
    order = np.lexsort((h, t.row))
    hs, rs = h[order], t.row[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    distinct = np.bincount(rs, new, t.n) / np.maximum(t.words, 1)
    expected = np.minimum(1.0, 0.9 * np.maximum(t.words, 1) ** -0.12)
    vote(4, expected - distinct, 0.35, 0.15, 30)
    short = t.rate((letters > 0) & (letters <= 4) & (size <= 6))
    vote(5, 0.3 - short, 0.22, 0.12, 20)
    mean = np.bincount(t.row, size, t.n) / np.maximum(t.words, 1)
    vote(6, np.abs(mean - 5.5), 5.0, 2.5)
    # lines that stand more than once
    out[:, 7] = _line_votes(t)
    return out


def _line_votes(t: Texts) -> np.ndarray:
    table = np.ones(256, bool)
    table[10] = False
    s, e, b = find_words(t.data, t.off, table)
    n = np.diff(b)
    row = np.repeat(np.arange(t.n), n)
    h = hash_spans(t.data, s, e) if len(s) else np.zeros(0, np.uint64)
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    repeated = 1 - np.bincount(rs, new, t.n) / np.maximum(n, 1)
    return (np.where(repeated >= 0.4, -1, np.where(repeated <= 0.1, 1, 0)) * (n >= 4)).astype(np.int8)


def features(t: Texts):
    """(row, slot, value) of the hashed features, values scaled to unit length per text."""
    if not len(t.starts):
        z = np.zeros(0)
        return z.astype(np.int64), z.astype(np.int64), z
    h = hash_spans(t.data, t.starts, t.ends)
    bits = _SHAPE[t.data]
    # union of byte shapes in a word, and of its first and last byte
    shape = np.zeros(len(h), np.uint64)
    for k in range(6):
        c = np.concatenate([[0], np.cumsum((bits >> k) & 1, dtype=np.int32)])
        shape |= (c[t.ends] > c[t.starts]).astype(np.uint64) << np.uint64(k)
    size = np.minimum(t.ends - t.starts, 20).astype(np.uint64)
    edge = (t.data[t.starts].astype(np.uint64) << np.uint64(8)) | t.data[t.ends - 1]
    shape_key = mix(shape * np.uint64(64) + np.uint64(7))
    size_key = mix(shape * np.uint64(4096) + size * np.uint64(64) + np.uint64(11))
    edge_key = mix((shape << np.uint64(20)) + edge * np.uint64(8) + np.uint64(13))
    pair = mix(shape_key[:-1] * np.uint64(3) + shape_key[1:]) if len(h) > 1 else h[:0]
    same = t.row[:-1] == t.row[1:]
    twice = np.flatnonzero(same & (h[:-1] == h[1:]))  # a word right after itself
    keys = np.concatenate([h, shape_key, size_key, edge_key, pair[same], np.full(len(twice), 1 << 63, np.uint64)])
    rows = np.concatenate([t.row, t.row, t.row, t.row, t.row[:-1][same], t.row[twice]])
    slot = (keys >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    size = 1 << FEATURE_BITS
    flat, count = np.unique(rows * size + slot, return_counts=True)
    rows, slot = flat >> FEATURE_BITS, flat & (size - 1)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(rows, value * value, t.n))
    return rows, slot, value / norm[rows]


def _votes_task(schema):
    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                t = Texts(part.column("text"))
                code = ((votes(t).astype(np.int64) + 1) * 3 ** np.arange(len(LABELLERS))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(code), pa.array(t.words > 0)], schema=schema)
    return run


def _features_task(schema):
    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                rows, slot, value = features(Texts(part.column("text")))
                at = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(part)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("code"), pa.ListArray.from_arrays(pa.array(at), pa.array(slot.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(value.astype(np.float32)))], schema=schema)
    return run


def label_model(codes: np.ndarray, counts: np.ndarray, rounds: int = 300):
    """Posterior of "good" per vote pattern by expectation-maximisation.

    Labellers overlap but mostly find one kind of bad text each, so the bad
    class is a mixture of kinds, one started from each labeller (it calls 90 %
    of its kind bad, others 5 %; 0.2 % of good texts). Given the kind, votes are
    independent, and silence says nothing. Pseudo-counts of the start name the
    classes and steady labellers with few votes; for good texts they weigh as
    much as the data, since a kind that one labeller alone finds could as well
    be its error rate on good texts. Returns (posterior, rates of
    "bad" votes by kind with the good texts last, shares of the kinds)."""
    k = len(LABELLERS)
    v = (codes[:, None] // 3 ** np.arange(k)) % 3  # 0 bad, 1 none, 2 good
    called, spoke = v == 0, v != 1
    start = np.full((k + 1, k), 0.05)
    start[np.arange(k), np.arange(k)] = 0.9
    start[k] = 0.002
    rate, share = start.copy(), np.append(np.full(k, 0.15 / k), 0.85)
    belief = np.append(np.full(k, 20.0), counts.sum())[:, None]
    post = np.zeros(len(codes))
    for _ in range(rounds):
        log = np.log(share) + called @ np.log(rate).T + (spoke & ~called) @ np.log1p(-rate).T
        w = np.exp(log - log.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        if np.max(np.abs(w[:, k] - post), initial=0) < 1e-9:
            break
        post = w[:, k].copy()
        w *= counts[:, None]
        rate = np.clip((w.T @ called + belief * start) / (w.T @ spoke + belief), 1e-4, 1 - 1e-4)
        share = (w.sum(axis=0) + 1) / (w.sum() + k + 1)
    return post, rate, share


def train(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS):
    """(weights of the hashed scorer with the bias last, labellers' rates of "bad" votes by kind, good texts last), or None without words."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(text_col).cast("string").alias("text"))
    src = src.select(F.xxhash64("text", F.lit(10)).alias("key"), "text")
    schema = pa.schema([("key", pa.int64()), ("code", pa.int64()), ("some", pa.bool_())])
    coded = cut_lineage(src.mapInArrow(_votes_task(schema), "key bigint, code bigint, some boolean").where("some").drop("some"))
    seen = coded.groupBy("code").count().collect()
    if not seen:
        return None
    codes, counts = np.array([r["code"] for r in seen]), np.array([r["count"] for r in seen], float)
    post, rates, share = label_model(codes, counts)
    # a bounded sample: half of it from patterns called bad, which are rare
    soft = docs.sparkSession.createDataFrame([(int(c), float(q)) for c, q in zip(codes, post)], "code bigint, q double")
    picked = None
    keyed = coded.distinct().join(F.broadcast(soft), "code")  # a row per vote pattern, at most 3**labellers
    for side in ("q < 0.5", "q >= 0.5"):
        part = keyed.where(side).orderBy("key").limit(sample_rows // 2)
        picked = part if picked is None else picked.unionAll(part)
    picked = cut_lineage(picked)  # at most sample_rows rows
    texts = src.join(F.broadcast(picked), "key").dropDuplicates(["key"]).select("code", "text")
    fschema = pa.schema([("code", pa.int64()), ("slot", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])
    rows = texts.mapInArrow(_features_task(fschema), "code bigint, slot array<int>, value array<float>").toArrow()
    q = dict(zip(codes.tolist(), post.tolist()))
    y = np.array([q[c] for c in rows["code"].to_pylist()])
    n = pc.list_value_length(rows["slot"]).to_numpy()
    row = np.repeat(np.arange(len(y)), n)
    return fit_linear(row, pc.list_flatten(rows["slot"]).to_numpy(), pc.list_flatten(rows["value"]).to_numpy(), y, float(share[-1])), rates


def fit_linear(row, slot, value, y, good: float, steps: int = 150, rate: float = 2.0, ridge: float = 1e-4):
    """Logistic regression on soft labels by Adam steps; ``good`` is the share of
    the total weight that good texts get (the sample holds more bad ones)."""
    size = 1 << FEATURE_BITS
    w, b = np.zeros(size), 0.0
    m1, m2 = np.zeros(size + 1), np.zeros(size + 1)
    pos, neg = max(y.sum(), 1e-9), max((1 - y).sum(), 1e-9)
    cw = good * y / pos + (1 - good) * (1 - y) / neg
    for k in range(1, steps + 1):
        z = np.bincount(row, w[slot] * value, len(y)) + b
        g = cw * (1 / (1 + np.exp(-z)) - y)
        grad = np.append(np.bincount(slot, g[row] * value, size) + ridge * w, g.sum())
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        step = rate * 0.05 * (m1 / (1 - 0.9 ** k)) / (np.sqrt(m2 / (1 - 0.99 ** k)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    return np.append(w, b).astype(np.float32)


def scores(arr: pa.Array, weights: np.ndarray | None) -> np.ndarray:
    """Score 0-1 of each text; 0 without words or model."""
    out = []
    for lo, hi in slices(arr):
        t = Texts(arr.slice(lo, hi - lo))
        if weights is None:
            out.append(np.zeros(t.n))
            continue
        rows, slot, value = features(t)
        z = np.bincount(rows, weights[slot] * value, t.n) + weights[-1]
        out.append(np.where(t.words > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0))
    return np.concatenate(out) if out else np.zeros(0)


def _score_task(shared, schema, keep_at, at):
    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(at)):  # small pieces out: nothing of a batch's size is copied
                part = batch.slice(lo, hi - lo)
                s = scores(part.column(at), shared.value)
                if keep_at is None:
                    yield pa.RecordBatch.from_arrays([*part.columns[:len(schema) - 1], pa.array(s)], schema=schema)
                else:
                    yield pa.RecordBatch.from_arrays(part.columns[:len(schema)], schema=schema).filter(pa.array(s >= keep_at))
    return run


def _scored(docs: DataFrame, cols: list[str], text_col: str, model, keep_at):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructType
    src, at = with_text(docs, cols, text_col)
    kind = StructType(src.schema.fields[:len(cols)])
    if keep_at is None:
        kind = StructType([*kind.fields]).add("_score", DoubleType())
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**FEATURE_BITS + 1 floats
    out = src.mapInArrow(_score_task(shared, to_arrow_schema(kind), keep_at, at), kind)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], *(["_score"] if keep_at is None else []))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """(id, score, keep) for every row; the model is trained on the same table."""
    got = train(docs, text_col)
    out = _scored(docs, [id_col], text_col, got and got[0], None)
    return out.select(F.col(id_col), F.col("_score").alias("score"), (F.col("_score") >= keep_at).alias("keep"))


def keep_good(docs: DataFrame, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows that are not rejected, all columns kept."""
    got = train(docs, text_col)
    return _scored(docs, docs.columns, text_col, got and got[0], keep_at)
