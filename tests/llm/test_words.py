import re

import numpy as np
import pyarrow as pa

from tabprobe.llm import words as W

TEXTS = ["The cat\x0bsat  on\tthe mat.", "", None, "ÄÖ b-c 12_3 é日本 x", " \n ", "A" * 3000 + " b", "a\x00b \x7f c|d", "the CAT"]


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def split(t, pattern):
    return re.findall(pattern, lower(t))


def check(table, pattern, texts):
    data, s, e, bounds, h = W.hashed_words(pa.array(texts, pa.string()), table)
    seen = {}
    for i, t in enumerate(texts):
        want = split(t, pattern)
        got = [W.lowered(data, s[x], e[x]) for x in range(bounds[i], bounds[i + 1])]
        assert got == want
        for w, x in zip(want, h[bounds[i]:bounds[i + 1]].tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_words_and_hashes_agree_with_patterns():
    check(W.SPACE_WORDS, r"[^\x20\x09-\x0D]+", TEXTS)
    check(W.ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", TEXTS)


def test_sliced_arrays_and_long_chunks():
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("abcdé"), 5)) for _ in range(300)) for _ in range(40)] + ["x " * 700_000]
    arr = pa.array(["skip", *texts])[1:]
    parts = list(W.slices(arr, 10_000))
    assert parts[0][0] == 0 and parts[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    check(W.SPACE_WORDS, r"[^\x20\x09-\x0D]+", texts)
    whole = W.hashed_words(arr, W.SPACE_WORDS)[4]
    again = np.concatenate([W.hashed_words(arr.slice(a, b - a), W.SPACE_WORDS)[4] for a, b in parts])
    assert (whole == again).all()


def test_shingles_are_word_sequences():
    texts = ["a b c d a b c", "a b", "", None, "a", "c d a b c x"]
    _, _, _, b, h = W.hashed_words(pa.array(texts, pa.string()), W.SPACE_WORDS)
    v, r = W.shingles(h, b, 3)
    seen = {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        want = [tuple(w[x:x + 3]) for x in range(max(len(w) - 2, 1))] if w else []
        got = v[r == i].tolist()
        assert len(got) == len(want)
        for x, y in zip(want, got):
            assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)
