"""Language identification with a linear-chain conditional random field.

Words of a text form a chain whose labels are languages. Emission scores come
from learned weights of hashed features of the word: affixes, letter n-grams and the
word itself (lexicon); transition scores between neighbouring words are learned
too. Forward-backward gives every word's label probabilities, so words of
code-switched texts get their own language; a text's prediction is the label with
the largest mean probability over its words.

Training maximises the chain's conditional likelihood on sequences cut from
labelled texts: a bounded sample of rows (``SAMPLE_ROWS`` chosen by hash, evenly by
language, and ``LANGUAGE_ROWS`` of each if there are many), whose words all carry the
text's label; neighbouring texts of the sample are joined now and then, which shows the
model switches. Every language that occurs is learned.

Scale: prediction is row-wise over whole texts; features are computed once per
distinct word of a chunk, and the recursions run on blocks of words side by
side, joined by their transfer matrices, so a long text costs no more per word; with many
languages the blocks are wider, so that the matrices stay within ``CELLS``. The model
takes 64 KB a language, whatever the rows.

Defined results: null texts and texts without letters are ``und`` with score 0;
rows with null text or language are not learned from; without labels all texts
are ``und``; repeated rows get the same result; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.llm.words import CHUNK_BYTES, find_words, hash_spans, mix, slices, text_buffers

SAMPLE_ROWS = 2000  # documented bound of the training sample
LANGUAGE_ROWS = 20  # rows of each language sampled at least, where it has them
SAMPLE_WORDS = 400_000  # about as many words of the sample are trained on, in whole texts (and one text of each language at least)
CELLS = 1 << 22  # numbers held at once in transfer matrices or in a training step
BITS = 14
LEAD, STEPS, RATE = 64, 60, 0.3
BLOCK = 32  # words handled one after another; blocks are handled side by side
_LETTERS = np.zeros(256, bool)  # ASCII letters and all non-ASCII bytes
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_ASCII = _LETTERS & (np.arange(256) < 128)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(word, slot) pairs: the word, its first and last one to three letters' bytes
    and its byte trigrams (with A-Z lower-cased)."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    size = ends - starts
    n = len(starts)
    words, keys = [np.arange(n)], [hash_spans(data, starts, ends)]
    for k in (1, 2, 3, 4):
        long = np.flatnonzero(size >= k)
        for tag, at in ((k, starts[long]), (8 + k, ends[long] - k)):
            key = np.full(len(long), tag, np.uint64)
            for j in range(k):
                key = key * np.uint64(257) + low[at + j]
            words.append(long)
            keys.append(mix(key + np.uint64(0xABCD)))
    count = np.maximum(size - 2, 0)
    owner = np.repeat(np.arange(n), count)
    first = np.cumsum(count) - count
    at = np.arange(int(count.sum())) - np.repeat(first, count) + np.repeat(starts, count)
    words.append(owner)
    keys.append(mix((low[at] * np.uint64(65536) + low[at + 1] * np.uint64(256) + low[at + 2]) + np.uint64(0x77770000000)))
    return np.concatenate(words), (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)


def text_words(arr: pa.Array):
    """(data, starts, ends, bounds) of the letter words of a string array."""
    data, off = text_buffers(arr)
    starts, ends, bounds = find_words(data, off, _LETTERS)
    return data, starts, ends, bounds


class Chain:
    """Emission weights (slots x labels), transitions and start scores."""

    def __init__(self, labels: list[str], weights: np.ndarray, moves: np.ndarray, begin: np.ndarray):
        self.labels, self.weights, self.moves, self.begin = labels, weights, moves, begin

    def emissions(self, data, starts, ends):
        """(distinct words, labels) scores and each word's number."""
        _, first, number = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        order = np.argsort(first)  # spans in order, as the helpers expect
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        first = first[order]
        word, slot = word_features(data, starts[first], ends[first])
        e = np.zeros((len(first), len(self.labels)), np.float64)
        for k in range(len(self.labels)):
            e[:, k] = np.bincount(word, self.weights[slot, k], len(first))
        return e, rank[number], word, slot


def _softplus_rows(e: np.ndarray) -> np.ndarray:
    """exp of scores, rows scaled so that the largest is 1."""
    return np.exp(e - e.max(axis=1, keepdims=True))


def block_width(count: np.ndarray, labels: int, cells: int = CELLS) -> int:
    """Words in a block, so that the blocks' transfer matrices hold at most ``cells`` numbers;
    blocks as long as the longest text need none."""
    width = BLOCK
    while width < count.max(initial=0) and int((-(-count // width)).sum()) * labels * labels > cells:
        width *= 2
    return width


def posteriors(emit: np.ndarray, bounds: np.ndarray, moves: np.ndarray, begin: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Label probabilities of every word by forward-backward. ``emit``: positive
    emission factors by word; ``bounds``: words before each text."""
    n, m = emit.shape
    if n == 0:
        return np.zeros((0, m))
    t = np.exp(moves)
    b = np.exp(begin - begin.max())
    # blocks of words that do not cross texts
    count = np.diff(bounds)
    block = block_width(count, m, cells)
    per = -(-count // block)
    text = np.repeat(np.arange(len(count)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    first = bounds[:-1][text] + nth * block
    size = np.minimum(block, bounds[1:][text] - first)
    nb = len(first)
    order = np.argsort(-size, kind="stable")
    first, size, text, nth = first[order], size[order], text[order], nth[order]
    block = int(size.max())
    live = np.searchsorted(-size, -np.arange(block), side="left").tolist()  # blocks longer than j
    at = np.empty(nb, np.int64)
    at[order] = np.arange(nb)  # place of the blocks in text order
    # transfer matrix of each block: product of (transition x emission), scaled
    if per.max(initial=0) > 1:
        mat = np.broadcast_to(np.eye(m), (nb, m, m)).copy()
        for j in range(block):
            k = live[j]
            moved = mat[:k] @ t
            if j == 0:
                moved[nth == 0] = np.eye(m)  # nothing stands before a text
            mat[:k] = moved * emit[first[:k] + j][:, None, :]
            mat[:k] /= mat[:k].sum(axis=(1, 2), keepdims=True)
    # into each block: the forward vector before it (the start factors at a text's start), the backward vector after it
    into, after = np.empty((nb, m)), np.ones((nb, m))
    head = np.cumsum(per) - per
    for r in range(int(per.max(initial=0))):
        texts = np.flatnonzero(per > r)
        here = at[head[texts] + r]
        if r == 0:
            v = np.broadcast_to(b, (len(texts), m))
        else:
            prev = at[head[texts] + r - 1]
            v = np.einsum("ni,nij->nj", into[prev], mat[prev])
            v = v / np.abs(v).sum(axis=1, keepdims=True)
        into[here] = v
    for r in range(int(per.max(initial=0)) - 2, -1, -1):
        texts = np.flatnonzero(per > r + 1)
        here, nxt = at[head[texts] + r], at[head[texts] + r + 1]
        v = np.einsum("nij,nj->ni", mat[nxt], after[nxt])
        after[here] = v / v.sum(axis=1, keepdims=True)
    # within the blocks, side by side
    fwd = np.empty((n, m))
    v = into
    for j in range(block):
        k = live[j]
        moved = v[:k] @ t
        if j == 0:
            moved[nth == 0] = b
        v = moved * emit[first[:k] + j]
        v /= v.sum(axis=1, keepdims=True)
        fwd[first[:k] + j] = v
    post = fwd
    v = after.copy()
    for j in range(block - 1, -1, -1):
        k = live[j]
        w = first[:k] + j
        p = fwd[w] * v[:k]
        p /= p.sum(axis=1, keepdims=True)
        post[w] = p
        step = (v[:k] * emit[w]) @ t.T
        v[:k] = step / step.sum(axis=1, keepdims=True)
    return post


def predict(arr: pa.Array, model: Chain | None):
    """(labels, scores) of the texts of an array."""
    out, scores = [], []
    # the tables of a slice hold words x labels numbers
    for lo, hi in slices(arr, CHUNK_BYTES * 16 // max(16, len(model.labels) if model else 0)):
        part = arr.slice(lo, hi - lo)
        data, starts, ends, bounds = text_words(part)
        count = np.diff(bounds)
        # words without an ASCII letter may hold signs only: those texts are looked at
        plain = np.concatenate([[0], np.cumsum(_ASCII[data], dtype=np.int64)])
        _, off = text_buffers(part)
        for i in np.flatnonzero((count > 0) & (plain[off[1:]] == plain[off[:-1]])).tolist():
            if not any(map(str.isalpha, part[i].as_py())):
                count[i] = 0
        if model is None or not len(starts):
            out += ["und"] * len(count)
            scores.append(np.zeros(len(count)))
            continue
        e, number, _, _ = model.emissions(data, starts, ends)
        post = posteriors(_softplus_rows(e)[number], bounds, model.moves, model.begin)
        row = np.repeat(np.arange(len(count)), np.diff(bounds))
        mean = np.stack([np.bincount(row, post[:, k], len(count)) for k in range(post.shape[1])], axis=1) / np.maximum(count, 1)[:, None]
        best = mean.argmax(axis=1)
        out += [model.labels[b] if c else "und" for b, c in zip(best, count)]
        scores.append(np.where(count > 0, np.clip(mean.max(axis=1), 0, 1), 0.0))
    return out, np.concatenate(scores) if scores else np.zeros(0)


# ---------------------------------------------------------------- training

def fit(texts: list[str], langs: list[str], seed: int = 5) -> Chain:
    """Train on labelled texts (their order decides which ones are joined)."""
    labels = sorted(set(langs))
    index = {x: i for i, x in enumerate(labels)}
    data, starts, ends, bounds = text_words(pa.array(texts))
    count = np.diff(bounds)
    gold = np.repeat(np.array([index[x] for x in langs]), count)
    m, n = len(labels), len(gold)
    model = Chain(labels, np.zeros((1 << BITS, m)), np.zeros((m, m)), np.zeros(m))
    if n == 0 or m == 1:
        return model
    _, number, word, slot = model.emissions(data, starts, ends)
    vocab = int(number.max()) + 1
    # chains of LEAD words over the joined texts: most hold one language, some a switch
    cuts = np.arange(0, n + LEAD, LEAD)
    cuts = np.unique(np.minimum(cuts, n))
    used = np.bincount(slot, minlength=1 << BITS) > 0
    g1 = {k: np.zeros_like(v) for k, v in (("w", model.weights), ("t", model.moves), ("b", model.begin))}
    rng = np.random.default_rng(seed)
    chains = len(cuts) - 1
    step = max(1, min(chains // 8, CELLS // (LEAD * m)))
    for it in range(STEPS):
        pick = np.sort(rng.permutation(chains)[:step]) if chains > 8 else np.arange(chains)
        idx = np.concatenate([np.arange(cuts[c], cuts[c + 1]) for c in pick])
        cb = np.concatenate([[0], np.cumsum(cuts[pick + 1] - cuts[pick])])
        e = np.stack([np.bincount(word, model.weights[slot, k], vocab) for k in range(m)], axis=1)
        emit = _softplus_rows(e)[number[idx]]
        post = posteriors(emit, cb, model.moves, model.begin)
        # expected moves between neighbours need the pair probabilities
        inner = np.ones(len(idx), bool)
        inner[cb[:-1]] = False
        j = np.flatnonzero(inner)
        pair = pair_posteriors(emit, cb, model.moves, model.begin, j)
        want = np.zeros((m, m))
        np.add.at(want, (gold[idx[j - 1]], gold[idx[j]]), 1)
        diff = -post
        diff[np.arange(len(idx)), gold[idx]] += 1
        by_word = np.stack([np.bincount(number[idx], diff[:, k], vocab) for k in range(m)], axis=1)
        grad_w = np.stack([np.bincount(slot, by_word[word, k], 1 << BITS) for k in range(m)], axis=1) - 1e-2 * model.weights * used[:, None]
        start = np.zeros(m)
        for g in gold[idx[cb[:-1]]]:
            start[g] += 1
        grad_t = want - pair - 0.1 * model.moves
        grad_b = start - post[cb[:-1]].sum(axis=0) - 0.1 * model.begin
        for key, value, grad in (("w", model.weights, grad_w), ("t", model.moves, grad_t), ("b", model.begin, grad_b)):
            g1[key] += grad * grad
            value += RATE * grad / np.sqrt(g1[key] + 1e-6)
    model.weights = model.weights.astype(np.float32)
    return model


def pair_posteriors(emit, bounds, moves, begin, inner):
    """Summed probabilities of (label before, label) over the words ``inner``;
    chains are at most LEAD words, so plain recursions over positions do."""
    m = emit.shape[1]
    t = np.exp(moves)
    size = np.diff(bounds)
    most = int(size.max(initial=0))
    f, b = np.zeros((len(size), most, m)), np.ones((len(size), most, m))
    e = np.ones((len(size), most, m))
    ok = np.arange(most)[None, :] < size[:, None]
    e[ok] = emit
    v = np.exp(begin - begin.max())[None, :] * e[:, 0]
    f[:, 0] = v / v.sum(axis=1, keepdims=True)
    for j in range(1, most):
        v = (f[:, j - 1] @ t) * e[:, j]
        f[:, j] = v / v.sum(axis=1, keepdims=True)
    for j in range(most - 2, -1, -1):
        v = (np.where(ok[:, j + 1, None], b[:, j + 1] * e[:, j + 1], 1.0)) @ t.T
        v = np.where(ok[:, j + 1, None], v, 1.0)
        b[:, j] = v / v.sum(axis=1, keepdims=True)
    total = np.zeros((m, m))
    for j in range(1, most):
        on = ok[:, j]
        before, here = f[on, j - 1], e[on, j] * b[on, j]
        total += t * ((before / ((before @ t) * here).sum(axis=1, keepdims=True)).T @ here)
    return total


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Chain | None:
    """The chain learned from rows with text and language; None without any."""
    src = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL")
    langs = src.select("lang").distinct().count()
    if not langs:
        return None
    # rows by hash, as many for each language; chosen by key and size, then their texts are read
    keyed = src.select("lang", "text", F.xxhash64("text", F.lit(3)).alias("key"), F.length("text").alias("size"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("key", "size"))
    chosen = keyed.select("lang", "key", "size").distinct().withColumn("_n", nth).where(
        F.col("_n") <= max(LANGUAGE_ROWS, sample_rows // langs)).drop("_n").collect()
    budget, picked = SAMPLE_WORDS * 6 // langs, []
    spent: dict[str, int] = {}
    least: dict[str, tuple] = {}
    for r in sorted(chosen, key=lambda r: (r["key"], r["lang"])):
        least[r["lang"]] = min(least.get(r["lang"], (r["size"], r["key"])), (r["size"], r["key"]))
        if spent.get(r["lang"], 0) + r["size"] <= budget:
            spent[r["lang"]] = spent.get(r["lang"], 0) + r["size"]
            picked.append((r["lang"], r["key"]))
    # where no sampled text is within the budget, the shortest one is learned from
    picked += [(x, key) for x, (_, key) in least.items() if x not in spent]
    want = labelled.sparkSession.createDataFrame(picked, "lang string, key bigint")
    rows = (keyed.join(F.broadcast(want), ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text")).collect())
    rows.sort(key=lambda r: (r["key"], r["lang"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def _task(shared, schema):
    def run(batches):
        for batch in batches:
            lang, score = predict(batch.column("_text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], schema=schema)
    return run


def identify(docs: DataFrame, model: Chain | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StringType, StructType
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text"))
    kind = StructType([src.schema["id"]]).add("lang_pred", StringType()).add("score", DoubleType())
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS x labels floats
    return src.mapInArrow(_task(shared, to_arrow_schema(kind)), kind).withColumnRenamed("id", id_col)
