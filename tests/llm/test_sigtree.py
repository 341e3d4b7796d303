import random
import re

import numpy as np
import pytest

from tabprobe.llm import sigtree as S


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return frozenset(tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()


def brute(docs, k, num, den):
    """[(id, size, smallest id reachable)] by all pairs."""
    sets = [shingle_set(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return sorted(((d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def corpus(seed, families=8, copies=12, size=60):
    """Near copies at many distances around shared bases, and a shared passage."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocab, k=30))
    docs = []
    for f in range(families):
        base = rng.choices(vocab, k=rng.randint(5, size))
        for c in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.2:
                w = w[:-1]
            docs.append(" ".join(w) if f % 3 else passage + " " + " ".join(w[:12]))
    docs += [passage] * 5 + ["a b", "a b", "a", "", None, "A  B"]
    rng.shuffle(docs)
    return list(enumerate(docs, 10))


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("k,num,den,block", [(3, 9, 10, 1_000_000), (5, 8, 10, 1_000_000), (3, 8, 10, 300)])
def test_classes_equal_all_pairs(spark, k, num, den, block):
    docs = corpus(k * den + num)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, cls int, n int").repartition(4)
    assert got(S.near_duplicates(df, k, num, den, block_grams=block)) == brute(docs, k, num, den)


def test_odd_rows_and_empty_tables(spark, odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(S.near_duplicates(odd, 5, 8, 10)) == brute(docs, 5, 8, 10)
    assert S.near_duplicates(empty, 5, 8, 10).collect() == []
    assert S.first_of_each(empty).collect() == []


def test_first_of_each_keeps_one_row_per_class(spark, odd):
    kept = S.first_of_each(odd)
    assert kept.columns == odd.columns
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    classes = brute(docs, 5, 8, 10)
    want = len({c for _, n, c in classes if n and c is not None}) + sum(1 for _, n, c in classes if not n) + len({t for d, t in docs if d is None and shingle_set(t, 5)})
    rows = kept.collect()
    assert len(rows) == want
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert set(ids) == {d for d, n, c in classes if d is not None and (not n or c == d)}


def test_tree_join_finds_a_spanning_forest():
    rng = np.random.default_rng(3)
    sets = []
    for f in range(30):
        base = np.unique(rng.integers(0, 2**63, rng.integers(3, 200), dtype=np.uint64))
        for _ in range(rng.integers(1, 12)):
            keep = base[rng.random(len(base)) > rng.choice([0.0, 0.04, 0.1])]
            sets.append(keep if len(keep) else base)
    links = S.join_sets(sets, 9, 10)
    m = len(sets)
    full = {i: {j for j in range(m) if 10 * len(np.intersect1d(sets[i], sets[j])) >= 9 * len(np.union1d(sets[i], sets[j]))} for i in range(m)}
    assert all(j in full[i] for i, j in links)

    def classes(nb):
        seen, out = set(), []
        for i in range(m):
            if i not in seen:
                todo, c = [i], set()
                while todo:
                    x = todo.pop()
                    if x not in c:
                        c.add(x)
                        todo += nb[x]
                seen |= c
                out.append(frozenset(c))
        return set(out)
    nb = {i: set() for i in range(m)}
    for i, j in links:
        nb[i].add(j)
        nb[j].add(i)
    assert classes(nb) == classes(full)
    side = rng.integers(0, 2, m)
    assert all(side[i] != side[j] for i, j in S.join_sets(sets, 9, 10, side=side))


def test_long_texts_alone_make_no_hot_slots(spark):
    """Unrelated documents of 1,500 words share nothing, so no slot of the table is hot; a passage they share is."""
    rng = random.Random(8)
    texts = [" ".join(str(rng.randrange(10 ** 9)) for _ in range(1500)) for _ in range(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert np.unpackbits(S.profile(docs, 3, "doc_id", "text")[1]).sum() <= 20
    shared = spark.createDataFrame([(i, t + " one shared passage of words") for i, t in enumerate(texts)], "doc_id long, text string")
    assert np.unpackbits(S.profile(shared, 3, "doc_id", "text")[1]).sum() >= 3


def test_bitmaps_follow_the_sets_number_not_the_largest_set():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 1 << 64, 100, dtype=np.uint64)) for _ in range(10_000)] + [np.unique(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64))]
    assert S.SignatureTree(sets).maps.nbytes <= 2 * S.BITMAP_BYTES
