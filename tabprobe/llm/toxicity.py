"""Toxicity: a support vector machine on subsequence string kernels.

The gap-weighted subsequence kernel of two strings sums over their common
subsequences of ``ORDER`` signs, each weighted by ``DECAY`` to the power of the
lengths it spans, so ``id.i.ot`` and ``idxiot`` stay close to ``idiot``.
Landmarks (Nystrom) are substrings of labelled training texts, chosen greedily
to tell toxic from other texts. A text's kernel values with a landmark are
the largest one over its words and their rate among its distinct words; both are mapped
by the inverse square root of the landmarks' kernel matrix, and a linear support vector machine on top is
trained on the labels, its margin turned into a score by Platt's sigmoid.

Words are runs of non-space characters, lower-cased, reduced to their letters
(so inserted signs and digits vanish) and framed as ``^word$``; three or more
single letters in a row are read as one word. Every word is compared with every
landmark and its kernel value taken as it is (the rate takes its third power, so that
close words count, however many distant ones there are), each distinct word once in a
worker as long as its cache of ``CACHE_WORDS`` words holds it.

Scale: scoring is row-wise over whole texts. Substring counts are made by
Spark over the training sample (at most ``SAMPLE_ROWS`` labelled texts, half of
each kind at most, chosen by hash); the sigmoid weighs its rows by the counts of
all labelled texts, so scores keep the natural rate of toxic texts; the driver gets at most ``CANDIDATES`` substrings and one row of
kernel values per sampled text.

Defined results: null, empty and letterless texts score as texts without any
match; of several labels of one doc_id the largest counts; labels without a
document are ignored; without toxic or without other labels every score is 0;
repeated rows get the same score; other columns pass through ``keep_clean``.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.frames import with_text
from tabprobe.llm.words import SPACE_WORDS, find_words, hash_spans, mix, slices, text_buffers
from tabprobe.session import cut_lineage

SAMPLE_ROWS = 6000  # documented bound of the fitting sample
CANDIDATES = 600  # substrings that reach the driver
LANDMARKS = 48
ORDER = 3
DECAY = 0.5
LONGEST_WORD = 48  # letters compared at once: longer words are compared in overlapping parts
CACHE_WORDS = 1 << 18  # raw words whose kernel values a worker keeps: 60 MB
RATE = 40  # a text is full of a landmark when one word in RATE matches it
PREDICT_AT = 0.3
_GRAMS = (4, 5, 6)


def parts(word: str):
    """A long word in parts that overlap by half, so no landmark is lost."""
    if len(word) <= LONGEST_WORD:
        return [word]
    step = LONGEST_WORD // 2
    return [word[i:i + LONGEST_WORD] for i in range(0, len(word) - step, step)]


def kernel(words: np.ndarray, sizes: np.ndarray, landmark: np.ndarray) -> np.ndarray:
    """Subsequence kernel of many words (rows of code points, 0 after the end)
    with one landmark."""
    n, most = words.shape
    m = len(landmark)
    same = words[:, :, None] == landmark[None, None, :]
    inside = np.arange(most)[None, :] < sizes[:, None]
    same &= inside[:, :, None]
    lam = np.float32(DECAY)
    prev = np.ones((n, most + 1, m + 1), np.float32)  # K' of order 0
    for _ in range(ORDER - 1):
        cur = np.zeros_like(prev)
        for i in range(1, most + 1):
            run = np.zeros(n, np.float32)
            for j in range(1, m + 1):
                run = lam * run + np.where(same[:, i - 1, j - 1], lam * lam * prev[:, i - 1, j - 1], 0)
                cur[:, i, j] = lam * cur[:, i - 1, j] + run
        prev = cur
    total = np.zeros(n, np.float32)
    for i in range(1, most + 1):
        total += (same[:, i - 1, :] * prev[:, i - 1, :m]).sum(axis=1) * lam * lam
    return total


def _codes(words: list[str]):
    sizes = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(words), int(sizes.max(initial=1))), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out, sizes


class Landmarks:
    """Landmark strings ready to be compared with words.

    A subsequence of three signs is its middle sign with one sign on each side,
    so the kernel is a sum over pairs of equal middle signs: the product of what
    the two strings hold alike before them and of what they hold alike after
    them, each sign weighted by its distance. Every word is compared."""

    def __init__(self, strings: list[str]):
        self.strings, self.cache = strings, None
        self.codes = [np.array([ord(c) for c in z], np.uint32) for z in strings]
        self.own = np.array([kernel(*_codes([z]), c)[0] for z, c in zip(strings, self.codes)])
        self.signs = np.array(sorted({ord(c) for z in strings for c in z}), np.uint32)
        codes, sizes = _codes(strings)
        slot = self._slots(codes)
        inside = np.arange(codes.shape[1])[None, :] < sizes[:, None]
        before, after = self._sides(slot)
        self.slot, self.before, self.after = slot[inside], before[inside], after[inside]
        self.of = np.repeat(np.arange(len(strings)), sizes)
        # by sign: what is after and before its places, and the landmarks these belong to
        self.by_sign = []
        for c in range(len(self.signs)):
            at = np.flatnonzero(self.slot == c)
            by_mark = np.zeros((len(at), len(strings)), np.float32)
            by_mark[np.arange(len(at)), self.of[at]] = 1
            self.by_sign.append((self.before[at].T, self.after[at].T, by_mark))

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        """Each code point's place among the landmarks' signs, their number for any other."""
        n = len(self.signs)
        if not n:
            return np.zeros(codes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.signs, codes), n - 1)
        return np.where(self.signs[at] == codes, at, n)

    def _sides(self, slot: np.ndarray):
        """(words, places, signs): the signs before and after a place, by distance."""
        n, most = slot.shape
        lam = np.float32(DECAY)
        eye = np.eye(len(self.signs) + 1, len(self.signs), dtype=np.float32)
        before, after = (np.zeros((n, most, len(self.signs)), np.float32) for _ in range(2))
        for j in range(1, most):
            before[:, j] = lam * (before[:, j - 1] + eye[slot[:, j - 1]])
        for j in range(most - 2, -1, -1):
            after[:, j] = lam * (after[:, j + 1] + eye[slot[:, j + 1]])
        return before, after

    def values(self, words: list[str]) -> np.ndarray:
        """Kernel values over each landmark's own value, at most 1: (words, landmarks)."""
        return self.values_of(*_codes(words)) if words else np.zeros((0, len(self.strings)), np.float32)

    def values_of(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The same for words given as rows of code points, 0 after the end."""
        out = np.zeros((len(codes), len(self.strings)), np.float32)
        slots = self._slots(codes)
        known = (slots < len(self.signs)).sum(axis=1)
        order = np.argsort(sizes, kind="stable")
        order = order[known[order] >= ORDER]  # with fewer signs of the landmarks every value is 0
        for at in range(0, len(order), 2048):  # words of like length together
            pick = order[at:at + 2048]
            slot = slots[pick, :int(sizes[pick].max())]
            before, after = self._sides(slot)
            word = np.repeat(np.arange(len(pick)), slot.shape[1])
            slot, before, after = slot.ravel(), before.reshape(-1, len(self.signs)), after.reshape(-1, len(self.signs))
            total = np.zeros((len(pick), len(self.strings)), np.float32)
            for c, (left, right, by_mark) in enumerate(self.by_sign):
                here = np.flatnonzero(slot == c)
                if not len(here):
                    continue
                alike = (before[here] @ left) * (after[here] @ right)
                first = np.flatnonzero(np.diff(word[here], prepend=-1))
                total[word[here][first]] += np.add.reduceat(alike @ by_mark, first, axis=0)
            out[pick] = np.minimum(np.float32(DECAY * DECAY) * total / self.own, 1)
        return out


def chunk_words(arr: pa.Array):
    """(framed letter words, and per row its distinct ones: word, row; their number by row).

    Only distinct raw words are handled one by one."""
    data, off = text_buffers(arr)
    starts, ends, bounds = find_words(data, off, SPACE_WORDS)
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    _, first, raw = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
    buf = data.tobytes()
    letters = []
    for s, e in zip(starts[first].tolist(), ends[first].tolist()):
        w = buf[s:e].decode("utf-8", "replace").lower()
        letters.append(w if w.isalpha() else "".join(filter(str.isalpha, w)))
    size = np.array([len(w) for w in letters], np.int64)[raw]
    # runs of three or more single letters in a row are one word, spelled out
    some = np.flatnonzero(size > 0)
    one = size[some] == 1
    edge = np.ones(len(some), bool)
    edge[1:] = (row[some][1:] != row[some][:-1]) | (one[1:] != one[:-1])
    run = np.flatnonzero(edge)
    run = run[one[run]]
    stops = np.append(np.flatnonzero(edge), len(some))
    spelled, spelled_row = [], []
    for i, j in zip(run, stops[np.searchsorted(stops, run, side="right")]):
        if j - i >= 3:
            spelled.append("^" + "".join(letters[raw[some[x]]] for x in range(i, j)) + "$")
            spelled_row.append(row[some[i]])
    index: dict[str, int] = {}
    slots: list[list[int]] = []
    for w in letters:
        slots.append([index.setdefault(p, len(index)) for p in parts("^" + w + "$")] if len(w) > 1 else [])
    spell_slots = [[index.setdefault(p, len(index)) for p in parts(w)] for w in spelled]
    lead = np.array([x[0] if x else -1 for x in slots], np.int64)[raw] if slots else np.zeros(0, np.int64)
    at, rows = [lead[lead >= 0]], [row[lead >= 0]]
    longer = np.flatnonzero(np.array([len(x) > 1 for x in slots], bool)[raw]) if slots else []
    for i in longer:
        extra = slots[raw[i]][1:]
        at.append(np.array(extra))
        rows.append(np.full(len(extra), row[i]))
    for x, r in zip(spell_slots, spelled_row):
        at.append(np.array(x))
        rows.append(np.full(len(x), r))
    at, rows = np.concatenate(at).astype(np.int64), np.concatenate(rows).astype(np.int64)
    size = max(len(index), 1)
    pairs = np.unique(rows * size + at)  # a repeated word counts once
    rows, at = pairs // size, pairs % size
    return list(index), at, rows, np.bincount(rows, minlength=n)


def _letters() -> np.ndarray:
    """The lower-case letter of each code point below 2**16: 0 for other signs, 1 where it
    takes more than the sign alone to tell."""
    out = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        low = [x for x in chr(c).lower() if x.isalpha()]
        out[c] = ord(low[0]) if len(low) == 1 and ord(low[0]) < 1 << 16 else min(len(low), 1)
    out[0x3A3] = 1  # lower-cased by its place in the word
    return out


_LETTERS: list[np.ndarray] = []


class WordCache:
    """Kernel values of raw words that a worker has met, by the words' hash. At ``CACHE_WORDS`` words
    those not met again are dropped; a word that is gone is computed anew."""

    NOTHING, LETTER, WORD, LONG = range(4)  # no letters, one, a word, one that is compared in parts

    def __init__(self, marks: Landmarks):
        if not _LETTERS:
            _LETTERS.append(_letters())
        self.marks = marks
        self.values = np.empty((CACHE_WORDS, len(marks.strings)), np.float32)
        self._set(*(np.zeros(0, k) for k in (np.uint64, np.int8, np.uint64, np.int64)))

    def _set(self, keys, kind, name, at):
        self.keys, self.kind, self.name, self.at = keys, kind, name, at
        self.met = np.zeros(len(keys), bool)

    def _known(self, keys):
        pos = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return pos, self.keys[pos] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def _room(self, keys, new: int):
        """Make room for new words: those not met again go, or else all."""
        if len(self.keys) + new <= CACHE_WORDS:
            return
        keep = np.flatnonzero(self.met if 2 * int(self.met.sum()) <= CACHE_WORDS else np.zeros(len(self.keys), bool))
        if len(keep) + len(keys) > CACHE_WORDS:
            keep = keep[:0]
        self.values[:len(keep)] = self.values[self.at[keep]]
        self._set(self.keys[keep], self.kind[keep], self.name[keep], np.arange(len(keep)))

    def lookup(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(kind, name, values) of sorted distinct hashes, whose words are ``data[start:end]``; the name
        is a hash of the letters."""
        pos, known = self._known(keys)
        self.met[pos[known]] = True
        if not known.all():
            self._room(keys, int((~known).sum()))
            pos, known = self._known(keys)
            new = np.flatnonzero(~known)
            kind, name, codes, sizes = _decode(data, starts[new], ends[new])
            at = np.zeros(len(new), np.int64)
            words = np.flatnonzero(kind == self.WORD)
            base = len(self.keys)
            if len(self.keys) + len(new) > len(self.values):  # more distinct words in one piece than the cache holds
                self.values = np.concatenate([self.values[:base], np.empty((len(new), self.values.shape[1]), np.float32)])
            at[:] = base + np.arange(len(new))
            if len(words):
                self.values[at[words]] = self.marks.values_of(codes, sizes)
            order = np.searchsorted(self.keys, keys[new])
            met = np.insert(self.met, order, False)
            self._set(*(np.insert(x, order, y) for x, y in ((self.keys, keys[new]), (self.kind, kind), (self.name, name), (self.at, at))))
            self.met = met
            pos = np.searchsorted(self.keys, keys)
        return self.kind[pos], self.name[pos], self.at[pos]


def _text(data: np.ndarray, start: int, end: int) -> str:
    """The letters of a word, lower-cased."""
    return "".join(filter(str.isalpha, data[start:end].tobytes().decode("utf-8", "replace").lower()))


def _decode(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Letters of words ``data[start:end]``: (kind, name, and of those of kind WORD the framed code points and sizes)."""
    n = len(starts)
    long = ends - starts > 4 * LONGEST_WORD
    size = np.where(long, 0, ends - starts)
    flat = data[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    word = np.repeat(np.arange(n), size)[(flat & 0xC0) != 0x80]  # of each character
    points = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTERS[0][np.minimum(points, 0xFFFF)]
    odd = long.copy()
    odd[word[(letter == 1) | (points > 0xFFFF)]] = True  # told letter by letter
    use = (letter > 1) & ~odd[word]
    letter, word = letter[use], word[use]
    odd = np.flatnonzero(odd)
    if len(odd):
        texts = [_text(data, starts[i], ends[i]) for i in odd.tolist()]
        more = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        word = np.concatenate([word, np.repeat(odd, [len(t) for t in texts])])
        order = np.argsort(word, kind="stable")
        letter, word = np.concatenate([letter, more])[order], word[order]
    count = np.bincount(word, minlength=n)
    kind = np.where(count < 2, count, np.where(count + 2 > LONGEST_WORD, WordCache.LONG, WordCache.WORD)).astype(np.int8)
    of = np.flatnonzero(kind == WordCache.WORD)
    sizes = count[of] + 2
    codes = np.zeros((len(of), int(sizes.max(initial=2))), np.uint32)
    inside = np.arange(codes.shape[1])[None, :] < sizes[:, None]
    inside[:, 0] = False
    inside[np.arange(len(of)), sizes - 1] = False
    codes[inside] = letter[kind[word] == WordCache.WORD]
    codes[:, 0] = ord("^")
    codes[np.arange(len(of)), sizes - 1] = ord("$")
    name = np.zeros(n, np.uint64)
    name[of] = code_names(codes)
    return kind, name, codes, sizes


def code_names(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of code points; zeros at the end count nothing."""
    h = np.zeros(len(codes), np.uint64)
    for j in range(codes.shape[1]):
        c = codes[:, j].astype(np.uint64)
        h = np.where(c > 0, mix(h * np.uint64(0x9E3779B97F4A7C15) + c), h)
    return h


def text_values(arr: pa.Array, marks: Landmarks) -> np.ndarray:
    """(texts, 2 x landmarks): the largest kernel value over a text's words, then
    the rate of such values among its distinct words."""
    if marks.cache is None:
        marks.cache = WordCache(marks)
    cache = marks.cache
    data, off = text_buffers(arr)
    starts, ends, bounds = find_words(data, off, SPACE_WORDS)
    n, m = len(off) - 1, len(marks.strings)
    out = np.zeros((n, 2 * m), np.float32)
    row = np.repeat(np.arange(n), np.diff(bounds))
    keys, first, which = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
    kind, name, at = cache.lookup(keys, data, starts[first], ends[first])
    kind, name, at = kind[which], name[which], at[which]
    # words in parts, and runs of three or more single letters, which are one word spelled out
    rare: dict[str, int] = {}
    rare_at, rare_row = [], []

    def add(word, r):
        for part in parts("^" + word + "$"):
            rare_at.append(rare.setdefault(part, len(rare)))
            rare_row.append(r)
    for i in np.flatnonzero(kind == cache.LONG).tolist():
        add(_text(data, starts[i], ends[i]), row[i])
    some = np.flatnonzero(kind != cache.NOTHING)
    one = kind[some] == cache.LETTER
    edge = np.ones(len(some), bool)
    edge[1:] = (row[some][1:] != row[some][:-1]) | (one[1:] != one[:-1])
    heads = np.flatnonzero(edge)
    stops = np.append(heads[1:], len(some))
    for i, j in zip(heads[one[heads]].tolist(), stops[one[heads]].tolist()):
        if j - i >= 3:
            add("".join(_text(data, starts[x], ends[x]) for x in some[i:j].tolist()), row[some[i]])
    base, extra = len(cache.values), marks.values(list(rare))
    words = np.flatnonzero(kind == cache.WORD)
    at, row, name = at[words], row[words], name[words]
    if rare:
        made = list(rare)
        names = code_names(_codes(made)[0])
        at, row, name = (np.concatenate([x, y]) for x, y in ((at, base + np.array(rare_at)), (row, np.array(rare_row)), (name, names[rare_at])))
    if not len(at):
        return out
    order = np.lexsort((name, row))  # a repeated word counts once
    at, row, name = at[order], row[order], name[order]
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (name[1:] != name[:-1])
    at, row = at[new], row[new]
    if not len(at):
        return out
    total = np.bincount(row, minlength=n)
    head = np.flatnonzero(np.diff(row, prepend=-1))
    for lo in range(0, len(head), 64):  # texts of a bounded number together
        some = head[lo:lo + 64]
        end = head[lo + 64] if lo + 64 < len(head) else len(row)
        here = at[some[0]:end]
        mine = cache.values[np.minimum(here, base - 1)]
        mine[here >= base] = extra[here[here >= base] - base]
        rows = row[some]
        out[rows, :m] = np.maximum.reduceat(mine, some - some[0], axis=0)
        rate = np.add.reduceat(mine * mine * mine, some - some[0], axis=0)
        out[rows, m:] = np.minimum(1, RATE * rate / (total[rows, None] + 20))
    return out


# ---------------------------------------------------------------- training

def _text_grams(arr: pa.Array):
    """The distinct substrings of each text's words."""
    for lo, hi in slices(arr):
        words, at, row, total = chunk_words(arr.slice(lo, hi - lo))
        by_row: list[set] = [set() for _ in total]
        for w, r in set(zip(at.tolist(), row.tolist())):
            by_row[r].add(w)
        for mine in by_row:
            found = set()
            for w in mine:
                w = words[w]
                for n in _GRAMS:
                    found.update(w[i:i + n] for i in range(len(w) - n + 1))
            yield found


def _grams_task(batches):
    """Distinct substrings of each training text, counted within the task."""
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for found, label in zip(_text_grams(batch.column("text")), batch.column("toxic").to_pylist()):
            (toxic if label else clean).update(found)
    keys = list(toxic)
    keys += [g for g in clean if g not in toxic]
    for lo in range(0, len(keys), 50_000):
        some = keys[lo:lo + 50_000]
        yield pa.RecordBatch.from_pydict({"gram": pa.array(some, pa.string()), "t": pa.array([toxic[g] for g in some], pa.int64()),
                                          "c": pa.array([clean[g] for g in some], pa.int64())})


def _holders_task(grams):
    def run(batches):
        for batch in batches:
            held = []
            for found in _text_grams(batch.column("text")):
                held.append([i for i, g in enumerate(grams) if g in found])
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic").cast(pa.int32()), "held": pa.array(held, pa.list_(pa.int32()))})
    return run


def _values_task(shared):
    def run(batches):
        marks = Landmarks(shared)
        for batch in batches:
            v = np.concatenate([text_values(batch.column("text").slice(lo, hi - lo), marks) for lo, hi in slices(batch.column("text"))])
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic").cast(pa.int32()),
                                              "v": pa.array(list(v), pa.list_(pa.float32()))})
    return run


def choose_landmarks(grams: list[str], held: list[list[int]], toxic: np.ndarray, most: int = LANDMARKS) -> list[str]:
    """Greedy cover: the substring that adds the most toxic texts for the fewest
    others, each toxic text counting until several landmarks find it."""
    hit = np.zeros((len(toxic), len(grams)), bool)
    for i, h in enumerate(held):
        hit[i, h] = True
    pos, neg = hit[toxic], hit[~toxic]
    false = neg.sum(axis=0) / max(len(neg), 1)
    weight = np.ones(len(pos))
    chosen: list[int] = []
    sizes = np.array([len(g) for g in grams])
    framed = np.array([g[0] == "^" or g[-1] == "$" for g in grams])
    while len(chosen) < most and len(grams):
        gain = pos.T @ weight - 2 * false * len(pos) + 1e-3 * sizes + 1e-3 * framed
        gain[chosen] = -1
        k = int(np.argmax(gain))
        if gain[k] < 2:
            break
        chosen.append(k)
        weight[pos[:, k]] *= 0.4
    return [grams[k] for k in chosen]


def fit_svm(x: np.ndarray, y: np.ndarray, share: float | None = None, steps: int = 3000, ridge: float = 1e-4):
    """Linear support vector machine (squared hinge, classes weighted alike) by
    accelerated gradient steps; then Platt's sigmoid on its margins. ``share``
    is the rate of toxic texts that the sigmoid's rows are weighted to (none:
    that of the rows)."""
    s = np.where(y, 1.0, -1.0)
    cw = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1))
    x1 = np.hstack([x, np.ones((len(x), 1))])
    lip = 2 * np.linalg.norm(x1 * np.sqrt(cw)[:, None], 2) ** 2 + ridge
    w = z = np.zeros(x1.shape[1])
    t = 1.0
    for _ in range(steps):
        gap = np.maximum(0, 1 - s * (x1 @ z))
        new = z - (ridge * np.append(z[:-1], 0) - 2 * x1.T @ (cw * s * gap)) / lip
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    m = x1 @ w
    n1, n0 = y.sum(), (~y).sum()
    target = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.ones(len(y)) if share is None else np.where(y, share / max(n1, 1), (1 - share) / max(n0, 1)) * len(y)
    a, b = 2.0, 0.0
    for _ in range(100):  # Newton steps on the sigmoid's two parameters
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([(weight * (p - target) * m).sum() + 1e-3 * (a - 2), (weight * (p - target)).sum()])
        q = weight * p * (1 - p) + 1e-9
        h = np.array([[(q * m * m).sum() + 1e-3, (q * m).sum()], [(q * m).sum(), q.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -1, 1)
    return w, a, b


class Model:
    """Landmarks, Nystrom map, weights and sigmoid; picklable."""

    def __init__(self, strings, whiten, w, a, b):
        self.strings, self.whiten, self.w, self.a, self.b = strings, whiten, w, a, b
        self._marks = None

    def __getstate__(self):
        return (self.strings, self.whiten, self.w, self.a, self.b)

    def __setstate__(self, state):
        self.__init__(*state)

    def features(self, values: np.ndarray) -> np.ndarray:
        k = len(self.strings)
        return np.hstack([values[:, :k] @ self.whiten, values[:, k:] @ self.whiten])

    def scores(self, arr: pa.Array) -> np.ndarray:
        if self._marks is None:
            self._marks = Landmarks(self.strings)
        m = self.features(text_values(arr, self._marks)) @ self.w[:-1] + self.w[-1]
        return 1 / (1 + np.exp(-np.clip(self.a * m + self.b, -30, 30)))


def nystrom(strings: list[str]) -> np.ndarray:
    """Inverse square root of the landmarks' normalised kernel matrix."""
    marks = Landmarks(strings)
    codes, sizes = _codes(strings)
    k = np.stack([kernel(codes, sizes, z) for z in marks.codes], axis=1).astype(float)
    k /= np.sqrt(np.outer(marks.own, marks.own))
    val, vec = np.linalg.eigh((k + k.T) / 2)
    return (vec / np.sqrt(np.maximum(val, 1e-2))) @ vec.T


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model learned from labelled rows; None without both kinds of labels."""
    lab = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
                 .where("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max("toxic").alias("toxic")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    lab = cut_lineage(lab.join(texts.select("id").distinct(), "id"))  # ids and labels of the texts at hand
    known = {r["toxic"]: r["count"] for r in lab.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    if len(known) < 2:
        return None
    key = F.xxhash64(F.col("id"), F.lit(9))
    picked = None
    for side in ("toxic > 0", "toxic <= 0"):  # at most sample_rows rows in all
        part = lab.where(side).orderBy(key, "id").limit(sample_rows // 2)
        picked = part if picked is None else picked.unionAll(part)
    picked = cut_lineage(picked)
    # copies of one id are one text: the first in text order
    sample = cut_lineage(texts.join(F.broadcast(picked), "id").groupBy("id").agg(
        F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", (F.col("toxic") > 0).alias("toxic"))
        .repartition(8))
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    grams = (sample.mapInArrow(_grams_task, "gram string, t bigint, c bigint")
                   .groupBy("gram").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
                   .where("t >= 3"))
    rate_t, rate_c = (F.col("t") + 0.5) / (totals[True] + 1), (F.col("c") + 0.5) / (totals[False] + 1)
    best = [r["gram"] for r in grams.orderBy((F.col("t") * F.log(rate_t / rate_c)).desc(), "gram").limit(CANDIDATES).collect()]
    if not best:
        return None
    held = sample.mapInArrow(_holders_task(best), "toxic int, held array<int>").toArrow()
    y = held["toxic"].to_numpy() > 0
    strings = choose_landmarks(best, held["held"].to_pylist(), y)
    if not strings:
        strings = best[:LANDMARKS]
    got = sample.mapInArrow(_values_task(strings), "toxic int, v array<float>").toArrow()
    y = got["toxic"].to_numpy() > 0
    model = Model(strings, nystrom(strings), None, 1.0, 0.0)
    model.w, model.a, model.b = fit_svm(model.features(np.array(got["v"].to_pylist(), float)), y, known[True] / sum(known.values()))
    return model


# ---------------------------------------------------------------- scoring

def _score_task(shared, schema, keep_below, at):
    def run(batches):
        model = shared.value
        for batch in batches:
            for lo, hi in slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                s = model.scores(part.column(at)) if model is not None else np.zeros(len(part))
                if keep_below is None:
                    yield pa.RecordBatch.from_arrays([*part.columns[:len(schema) - 1], pa.array(s)], schema=schema)
                else:
                    yield pa.RecordBatch.from_arrays(part.columns[:len(schema)], schema=schema).filter(pa.array(s < keep_below))
    return run


def _scored(docs: DataFrame, cols: list[str], text_col: str, model, keep_below):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructType
    src, at = with_text(docs, cols, text_col)
    kind = StructType(src.schema.fields[:len(cols)])
    if keep_below is None:
        kind = StructType([*kind.fields]).add("_score", DoubleType())
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few landmarks and weights
    out = src.mapInArrow(_score_task(shared, to_arrow_schema(kind), keep_below, at), kind)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], *(["_score"] if keep_below is None else []))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for every row."""
    out = _scored(docs, [id_col], text_col, model, None)
    return out.select(F.col(id_col), F.col("_score").alias("score"), (F.col("_score") >= PREDICT_AT).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows that are not judged toxic, all columns kept."""
    return _scored(docs, docs.columns, text_col, model, PREDICT_AT)
