import re

import pytest

from tabprobe.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(docs, items, window=13):
    out = []
    grams = []
    for item, t in items:
        w = words(t)
        n = min(len(w), window)
        grams += [(item, tuple(w[i:i + n])) for i in range(len(w) - n + 1)] if n else []
    for doc, t in docs:
        w = words(t)
        hit, found = set(), set()
        for item, g in grams:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i:i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(item)
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and runs far away from the big bad wolf of the north"), (2, "Short item here"),
         (3, "short ITEM here"), (None, "null id item words"), (5, ""), (6, None), (7, "a a a a a a a a a a a a a a a a"), (8, "one")]


def documents(odd):
    base = ITEMS[0][1]
    extra = [(200, "x y " + base + " z"), (201, "x. " + " ".join(base.split()[3:16]) + "! tail"), (202, " ".join(base.split()[:12])),
             (203, "a " * 40), (204, "say short item here twice short-item-here"), (205, base + " " + base), (206, "null id item words one")]
    return extra + [(r["doc_id"], r["text"]) for r in odd.where("length(text) < 1000 OR text IS NULL").select("doc_id", "text").collect()]


@pytest.mark.parametrize("window,gram", [(13, 8), (5, 3)])
def test_spans_equal_brute_force(spark, odd, window, gram):
    docs = documents(odd)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_hit long").repartition(3)
    b = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, spans string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in D.contamination(d, b, window=window, gram=gram).collect()]
    assert sorted(got, key=str) == brute(docs, ITEMS, window)


def test_every_shared_span_is_found(spark):
    import random
    rng = random.Random(2)
    w = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(w, k=40))) for i in range(30)]
    docs = []
    for k in range(60):
        src = rng.choice(items)[1].split()
        n = rng.randint(10, 16)
        at = rng.randint(0, len(src) - n)
        docs.append((k, " ".join(rng.choices(w, k=rng.randint(0, 20)) + src[at:at + n] + rng.choices(w, k=rng.randint(0, 20)))))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in D.contamination(d, b).collect()]
    assert sorted(got, key=str) == brute(docs, items)


def test_drop_and_empty_tables(spark, odd, empty):
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = D.drop_contaminated(odd, b)
    assert kept.columns == odd.columns
    bad = sum(n > 0 and 20 * n >= m for _, m, n, _ in brute([(r["doc_id"], r["text"]) for r in odd.where("length(text) < 1000 OR text IS NULL").collect()], ITEMS))
    assert kept.count() == odd.count() - bad
    assert D.drop_contaminated(empty, b).count() == 0
    assert D.contamination(odd, b.limit(0)).where("n_hit > 0").count() == 0
