import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tabprobe.llm import language as L


def test_posteriors_equal_enumeration():
    rng = np.random.default_rng(0)
    m, sizes = 3, [1, 5, 0, 2, 6]
    b = np.concatenate([[0], np.cumsum(sizes)])
    emit, moves, begin = np.exp(rng.normal(size=(b[-1], m))), rng.normal(size=(m, m)), rng.normal(size=m)
    post = L.posteriors(emit, b, moves, begin)
    for lo, hi in zip(b[:-1], b[1:]):
        total = np.zeros((hi - lo, m))
        for labels in itertools.product(range(m), repeat=int(hi - lo)):
            p = np.exp(begin[labels[0]]) if labels else 1
            for j, s in enumerate(labels):
                p *= emit[lo + j, s] * (np.exp(moves[labels[j - 1], s]) if j else 1)
            for j, s in enumerate(labels):
                total[j, s] += p
        if hi > lo:
            assert np.allclose(total / total.sum(axis=1, keepdims=True), post[lo:hi])


@pytest.mark.parametrize("n", [31, 32, 33, 64, 1000])
def test_blocks_equal_plain_recursions(n):
    rng = np.random.default_rng(n)
    m = 4
    b = np.array([0, 3, 3 + n, 3 + n, 10 + n])
    emit, moves, begin = np.exp(2 * rng.normal(size=(b[-1], m))), rng.normal(size=(m, m)), rng.normal(size=m)
    post = L.posteriors(emit, b, moves, begin)
    t = np.exp(moves)
    for lo, hi in zip(b[:-1], b[1:]):
        if hi == lo:
            continue
        f, g = [np.exp(begin) * emit[lo]], [np.ones(m)]
        for j in range(lo + 1, hi):
            f.append((f[-1] @ t) * emit[j])
            f[-1] /= f[-1].sum()
        for j in range(hi - 1, lo, -1):
            g.append(t @ (emit[j] * g[-1]))
            g[-1] /= g[-1].sum()
        p = np.array(f) * np.array(g[::-1])
        assert np.allclose(p / p.sum(axis=1, keepdims=True), post[lo:hi])


def test_pair_sums_equal_moves_between_enumerated_chains():
    rng = np.random.default_rng(2)
    m, b = 2, np.array([0, 3, 4])
    emit, moves, begin = np.exp(rng.normal(size=(4, m))), rng.normal(size=(m, m)), rng.normal(size=m)
    total, z = np.zeros((m, m)), 0
    for s in itertools.product(range(m), repeat=3):
        p = np.exp(begin[s[0]]) * emit[0, s[0]] * emit[1, s[1]] * emit[2, s[2]] * np.exp(moves[s[0], s[1]] + moves[s[1], s[2]])
        z += p
        total[s[0], s[1]] += p
        total[s[1], s[2]] += p
    assert np.allclose(total / z, L.pair_posteriors(emit, b, moves, begin, np.array([1, 2])))


def test_switched_words_get_their_own_language():
    rng = np.random.default_rng(1)
    word = lambda s: "".join(rng.choice(s, 3))
    a, b = ["ba", "bo", "bi"], ["ke", "ku", "ka"]
    texts = [" ".join(word(x) for _ in range(30)) for x in (a, b) * 20]
    model = L.fit(texts, ["aa", "bb"] * 20)
    mixed = pa.array([" ".join([word(a) for _ in range(6)] + [word(b) for _ in range(6)])])
    data, s, e, bounds = L.text_words(mixed)
    em, number, _, _ = model.emissions(data, s, e)
    post = L.posteriors(np.exp(em - em.max(axis=1, keepdims=True))[number], bounds, model.moves, model.begin)
    assert post.argmax(axis=1).tolist() == [0] * 6 + [1] * 6


def test_texts_of_signs_only_have_no_language():
    model = L.fit(["ba bo bi", "ke ku ka"] * 5, ["aa", "bb"] * 5)
    got, score = L.predict(pa.array(["\u2013 \u2026 \u00bf!", "\u0661\u0662 12", "\U0001f600", "\u00e9", "ba \u2013", None, ""]), model)
    assert [g == "und" for g in got] == [True, True, True, False, False, True, True]
    assert [x == 0 for x in score] == [True, True, True, False, False, True, True]


def test_odd_rows(spark, odd, empty):
    model = L.train(odd.select("text", "lang"))
    out = L.identify(odd, model).collect()
    assert len(out) == odd.count()
    blank = {3, 4, 5, -5}
    for r in out:
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in {"xx", "yy", "zz", "und"}
        if r["doc_id"] in blank:
            assert r["lang_pred"] == "und" and r["score"] == 0
        elif r["doc_id"] is not None:
            assert r["lang_pred"] != "und"
    assert L.train(empty) is None and L.identify(empty, None).collect() == []
    assert {r["lang_pred"] for r in L.identify(odd, None).collect()} == {"und"}


def test_held_out_accuracy(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = E.queries()["op3_language_id"](spark, sf).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.97


def test_wider_blocks_give_the_same_probabilities():
    rng = np.random.default_rng(8)
    m, b = 5, np.array([0, 3, 203, 203, 210, 500])
    emit, moves, begin = np.exp(rng.normal(size=(500, m))), rng.normal(size=(m, m)), rng.normal(size=m)
    want = L.posteriors(emit, b, moves, begin)
    assert [L.block_width(np.diff(b), m, c) for c in (1 << 20, 200, 75, 0)] == [L.BLOCK, 4 * L.BLOCK, 512, 512]
    for cells in (200, 75, 0):
        assert np.allclose(L.posteriors(emit, b, moves, begin, cells), want)


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(3)
    names = [f"l{i:03}" for i in range(250)]
    letters = list("abcdefghijklmnoprstuvz")
    lexicon = {x: ["".join(rng.choice(letters, rng.integers(3, 8))) for _ in range(25)] for x in names}
    rows = [(i, " ".join(rng.choice(lexicon[x], 30)), x) for i, x in enumerate(names * 7)]
    seen, new = rows[:1500], rows[1500:]
    model = L.train(spark.createDataFrame(seen, "doc_id long, text string, lang string"))
    assert model.labels == names
    got = {r["doc_id"]: r["lang_pred"] for r in L.identify(spark.createDataFrame(new, "doc_id long, text string, lang string"), model).collect()}
    assert np.mean([got[i] == x for i, _, x in new]) >= 0.95
