"""The prefix trie against nodes enumerated one by one."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tabprobe.llm import trie as T
from tabprobe.llm.queries import rebuilt


def turn_key(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), len(text)


def by_conv(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, *turn_key(role, text)))
    return {c: [(k, n) for _, _, k, n in sorted(v)] for c, v in convs.items()}


def brute(convs):
    members = {}
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + ((len(members[p]) - 1) * p[-1][1] if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(nodes):
    return sorted((tuple(r) for r in nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256").collect()), key=str)


def made(seed, n, extra=()):
    """Turns of conversations with shared starts, copies, single turns and deep ones."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        kind = rng.random()
        if kind < 0.35:
            turns = ["same", "reply", "again"]  # a sequence that a third shares
        else:
            turns = [rng.choice("abc") * rng.randint(0, 3) for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 40 if c % 17 == 0 else 5]))]
        rows += [(c, t, rng.choice(["user", "assistant"]) if t > 2 else "user", x) for t, x in enumerate(turns)]
    return rows + list(extra)


ODD = [(None, 0, "user", "x"), (500, None, None, None), (500, 0, "user", None), (500, 0, "user", "tie"), (500, 0, "user", "tie"), (501, 1, "", ""),
       (-7, 0, "user", "x"), (-107, 3, None, "é\U0001f600"), (1 << 60, 0, "user", "same"), (502, 0, "user", "y" * 200_000), (503, None, "a", "bc"), (504, None, "ab", "c")]
SCHEMA = "conv_id long, turn long, role string, text string, id int, path string, chars int, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, "k") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("block", [1, 7, 100, T.BLOCK_TURNS])
def test_peel_and_merge(block, monkeypatch):
    """Blocks and ranges of every size give the nodes of the whole."""
    monkeypatch.setattr(T, "FAN", 3)
    convs = by_conv(made(1, 60, ODD))
    order = sorted(convs, key=lambda c: ("".join(k for k, _ in convs[c]), c))
    import numpy as np
    closed, partial, where = [], [], {}
    for b in range(0, len(order), block):
        some = order[b:b + block]
        got, part, _ = T.peel(np.array(some), ["".join(k for k, _ in convs[c]) for c in some], np.array([n for c in some for _, n in convs[c]] + [0]))
        for x in got:
            closed += [tuple(x[f][i] for f in ("low", "depth", "n", "kids", "leaves", "saved")) for i in range(len(x["low"]))]
        partial += [(b // block, *p) for p in part]
    while True:
        groups = {}
        for p in partial:
            groups.setdefault(p[0] // 3, []).append(p)
        partial = []
        for g, rows in groups.items():
            done, rest = T.merge(rows, len(groups) == 1)
            closed += [(low, depth, n, kids, leaves, saved) for _, low, depth, _, _, n, kids, leaves, saved in done]
            partial += [(g, *p) for p in rest]
        if len(groups) == 1:
            break
    assert not partial
    assert sorted(tuple(int(v) for v in x) for x in closed) == sorted((x[0], x[1], *x[3:7]) for x in brute(convs))


@pytest.mark.parametrize("block", [5, T.BLOCK_TURNS])
def test_trie_of_odd_turns(spark, block, monkeypatch):
    monkeypatch.setattr(T, "FAN", 3)
    monkeypatch.setattr(T, "CHUNK", 4)
    rows = made(2, 120, ODD)
    t = T.build(T.sequences(frame(spark, rows)), block)
    assert rows_of(T.with_ends_digest(t)) == brute(by_conv(rows))
    ends = {r["key"]: [] for r in t.ends.select("key").distinct().collect()}
    for r in t.ends.orderBy("key", "seq").collect():
        ends[r["key"]] += r["ids"]
    assert all(v == sorted(v) for v in ends.values())


def test_rebuilt_conversations(spark):
    import zlib
    rows = made(3, 230, ODD) + [(900 + i, 0, "user", "short") for i in range(1, 9)]  # 900 is absent
    convs = by_conv(rows)
    want = {}
    for c, s in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        want[c] = convs.get(first, [])[:h] + s[h:]
    got = {r["id"]: list(zip([r["path"][i:i + 32] for i in range(0, len(r["path"]), 32)], r["chars"])) for r in rebuilt(frame(spark, rows)).collect()}
    assert got == want
    assert rows_of(T.with_ends_digest(T.build(rebuilt(frame(spark, rows))))) == brute(want)


def test_no_conversations(spark):
    t = T.trie(frame(spark, ODD[:1]).where("conv_id > 0"))
    assert T.with_ends_digest(t).collect() == []


def test_deep_conversation(spark):
    rows = [(c, t, "user", str(t)) for c in (1, 2) for t in range(3000 + c)]
    t = T.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert rows_of(T.with_ends_digest(t)) == brute(by_conv(rows))
    assert t.nodes.agg(F.max("depth")).first()[0] == 3002
