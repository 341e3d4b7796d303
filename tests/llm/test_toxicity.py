import itertools

import numpy as np
import pyarrow as pa

from tabprobe.llm import toxicity as T


def slow_kernel(s, t):
    """Sum over common subsequences of ORDER signs of DECAY ** (spans)."""
    total = 0.0
    for i in itertools.combinations(range(len(s)), T.ORDER):
        for j in itertools.combinations(range(len(t)), T.ORDER):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += T.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_equals_its_definition():
    words = ["^idiot$", "^idxiot$", "^ab$", "^banana$", "^a$"]
    codes, sizes = T._codes(words)
    for z in ("^idio", "anan", "^ba"):
        got = T.kernel(codes, sizes, np.array([ord(c) for c in z], np.uint32))
        assert np.allclose(got, [slow_kernel(w, z) for w in words], rtol=1e-4)


def test_words_join_spelled_and_inserted_signs():
    words, at, row, n = T.chunk_words(pa.array(["An i.d.i.o.t and st*up1id x", "l o s e r", None, "", "a b", "123 !!", "i d\ni O t!"]))
    by = [{words[w] for w, r in zip(at, row) if r == i} for i in range(7)]
    assert by == [{"^an$", "^idiot$", "^and$", "^stupid$"}, {"^loser$"}, set(), set(), set(), set(), {"^idiot$"}]
    assert n.tolist() == [4, 1, 0, 0, 0, 0, 1]


def test_gapped_insults_and_clean_texts(spark, odd, empty):
    rng = np.random.default_rng(1)
    clean = ["".join(rng.choice(list("aeionrtl"), 6)) for _ in range(400)]
    docs, labels = [], []
    for i in range(400):
        w = list(rng.choice(clean, 40))
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w[rng.integers(40)] = str(rng.choice(["stupid", "moron"]))
        docs.append((i, " ".join(w)))
        labels.append((i, None, int(bad)))
    labels += [(0, None, 0), (9999, None, 1), (None, None, 1), (3, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.train(d, lab)
    s = {r["doc_id"]: r for r in T.score(d, model).collect()}
    assert np.mean([s[i]["predicted"] == (i % 4 == 0) for i in range(400)]) >= 0.99
    tricky = ["such a m.o.r.o.n", "you stuxpid thing", "m o r o n", "a st-up-id one", "aeion rtlaei nortla", "", None]
    assert (model.scores(pa.array(tricky)) >= T.PREDICT_AT).tolist() == [True] * 4 + [False] * 3
    out = T.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in out)
    kept = T.keep_clean(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r["predicted"] == 0 for r in out)
    assert T.score(empty, model).collect() == [] and T.train(empty, lab) is None
    assert T.train(d, lab.where("toxic = 0")) is None
    assert {r["score"] for r in T.score(odd, None).collect()} == {0.0}


def test_every_word_has_its_kernel_values():
    marks = T.Landmarks(["^idiot", "moron", "tupid$", "oron$"])
    words = ["^ixdxixoxt$", "^mxoxrxoxn$", "^sxtxuxpxixd$", "^radio$", "^tent$", "^zz$", "^日本$"]
    want = [[min(1, slow_kernel(w, z) / slow_kernel(z, z)) for z in marks.strings] for w in words]
    assert np.allclose(marks.values(words), want, rtol=1e-4)
    texts = pa.array(["zz ixdxixoxt", "mxoxrxoxn", "sxtxuxpxixd tent", "zz", ""])
    got = T.text_values(texts, marks)[:, :4]
    assert np.allclose(got[:3], [want[0], want[1], np.maximum(want[2], want[4])], rtol=1e-4)
    assert (got[:3].max(axis=1) > 0.05).all() and (got[3:] == 0).all()


def test_insults_with_a_letter_between_all_letters(spark):
    rng = np.random.default_rng(5)
    clean = ["".join(rng.choice(list("aeilbcfgh"), 6)) for _ in range(300)]

    def gapped(word):
        return "".join(c + str(rng.choice(list("xqzk"))) for c in word[:-1]) + word[-1]

    def text(i):
        bad = str(rng.choice(["stupid", "moron"]))
        return " ".join([*rng.choice(clean, 20), *([[], [bad], [gapped(bad)]][i % 3])])

    d = spark.createDataFrame([(i, text(i)) for i in range(600)], "doc_id long, text string")
    model = T.train(d, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)], "doc_id long, toxic int"))
    new = model.scores(pa.array([text(i) for i in range(300)])) >= T.PREDICT_AT
    assert new[2::3].mean() >= 0.95 and new[1::3].mean() >= 0.95 and new[::3].mean() <= 0.05


def test_scores_keep_the_natural_rate_above_the_bound(spark):
    """Half of the toxic texts look clean: their score is their rate among such texts, whatever the sample."""
    rng = np.random.default_rng(2)
    clean = ["".join(rng.choice(list("aeionrtl"), 6)) for _ in range(200)]
    docs = [(i, " ".join(rng.choice(clean, 30)) + (" stupid" if i % 20 == 0 else "")) for i in range(2000)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(2000)], "doc_id long, toxic int")
    plain = pa.array([t for i, t in docs if i % 20][:300])
    whole, bounded = (T.train(d, lab, sample_rows=n).scores(plain) for n in (T.SAMPLE_ROWS, 300))
    assert 0.02 < whole.mean() < 0.1 and 0.02 < bounded.mean() < 0.1  # 100 of 1,900
    assert np.mean(bounded >= T.PREDICT_AT) < 0.02


def test_held_out_accuracy(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.01"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = E.queries()["op9_toxicity"](spark, sf).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    clean = [r for r in held if not toxic[r["doc_id"]]]
    bad = [r for r in held if toxic[r["doc_id"]]]
    assert len(rows) == 1000 and np.mean([r["predicted"] == 0 for r in clean]) >= 0.9 and np.mean([r["predicted"] for r in bad]) >= 0.6
