import collections
import zlib

import numpy as np
import pytest

from tabprobe.llm import packing
from tabprobe.llm.queries import vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def check(rows, docs, tokenizer, capacity=2048):
    """Every id once, gapless sequences, padding only where a length is no power of two."""
    want = collections.Counter()
    for doc_id, text in docs:
        want[doc_id, np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()] += 1
    by_doc = collections.defaultdict(list)
    seqs = collections.defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        by_doc[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    for doc_id, pieces in by_doc.items():
        for (d, ids), n in want.items():
            if d != doc_id:
                continue
            total = len(ids) // 4
            for at in range(total):  # walk the pieces that start where the last one ended
                break
            mine = sorted((p["start"], p["length"], bytes(p["ids"])) for p in pieces if p["doc_tokens"] == total)
            at = 0
            while at < total:
                here = [m for m in mine if m[0] == at and ids[4 * at:4 * (at + m[1])] == m[2]]
                assert len(here) >= n
                at += here[0][1]
    assert sum(r["length"] for r in rows) == sum(len(ids) // 4 * n for (_, ids), n in want.items())
    for pieces in seqs.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity and at & (at - 1) == 0  # nothing to pad


def test_round_trip_of_odd_rows(odd, tokenizer):
    rows = packing.pack(odd, *vocabulary()).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()], tokenizer)


def test_small_capacity_and_tables(spark, odd, empty, tokenizer):
    assert packing.pack(empty, *vocabulary()).collect() == []
    few = odd.where("length(text) < 500 OR text IS NULL")
    check(packing.pack(few, *vocabulary(), capacity=64).collect(), [(r["doc_id"], r["text"]) for r in few.collect()], tokenizer, 64)
    with pytest.raises(ValueError):
        packing.pack(odd, *vocabulary(), capacity=1000)


@pytest.mark.parametrize("capacity", [65536, 131072])
def test_long_capacities_keep_places_apart(spark, odd, capacity):
    """Very many short documents: a task's last open bin is closed in many parts."""
    docs = spark.range(40_000).selectExpr("id AS doc_id", "'ab' AS text").repartition(3).unionAll(odd.select("doc_id", "text"))
    seqs = collections.defaultdict(list)
    for r in packing.pack(docs, *vocabulary(), capacity=capacity).select("sequence_id", "offset", "length").collect():
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in seqs.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(pieces, pieces[1:]))
        total = sum(b for _, b in pieces)
        assert total <= capacity and total & (total - 1) == 0


def test_cut_covers_lengths():
    n = np.array([1, 2047, 2048, 2049, 5000, 7])
    doc, start, size = packing._cut(n, 2048)
    for i, total in enumerate(n):
        mine = [(s, z) for d, s, z in zip(doc, start, size) if d == i]
        assert mine[0][0] == 0 and sum(z for _, z in mine) == total
        assert all(a + b == c for (a, b), (c, _) in zip(mine, mine[1:]))


def test_encoder_matches_the_tokenizer_file(tokenizer):
    import random

    from tabprobe.llm.bpe import encoder
    e = encoder(*vocabulary())
    rng = random.Random(1)
    signs = [*" \n\t'stmdrevl aZé1² !?.日 \r\x1f", "́", " ", "'s", "'ll", "  ", "<|endoftext|>", " '", "don't"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    ids, n = e.encode(texts)
    off = np.concatenate([[0], np.cumsum(n)])
    for i, t in enumerate(texts):
        assert tokenizer.encode(t, add_special_tokens=False).ids == ids[off[i]:off[i + 1]].tolist(), t


def test_query_digest(spark):
    import __spark_entry__ as E
    rows = E.queries()["op1_harmonic_packing"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    full = {(r["doc_id"], r["start"]): r for r in packing.pack(docs, *vocabulary()).collect()}
    assert len(rows) == len(full)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(bytes(full[r["doc_id"], r["start"]]["ids"]))


def test_pipeline_pieces_hold_their_ids(spark, odd, tokenizer):
    import corpus_pipeline as P
    few = odd.where("length(text) < 500 OR text IS NULL")
    rows = P.stage_pack(spark, few, "").collect()
    check(rows, [(r["doc_id"], r["text"]) for r in few.collect()], tokenizer)
    assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in rows)
