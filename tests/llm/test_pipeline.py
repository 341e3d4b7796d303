"""Each stage on its own input against a plain version, and the whole run."""

import collections

import pytest

import corpus_pipeline as P
from tabprobe.llm import quality, toxicity
from tabprobe.llm.queries import toxicity_model

from .test_decontaminate import brute as spans
from .test_packing import check
from .test_packing import tokenizer  # noqa: F401
from .test_sigtree import brute as classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(docs)
    return seen


def rows(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_order_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "toxicity", "near_copies", "decontaminate", "pack"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])
    counts = [d.count() for d in stages[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0


def test_quality_stage(spark, stages):
    keep = {r["doc_id"] for r in quality.judge(stages[0]).where("keep").collect()}
    assert rows(stages[1]) == rows(stages[0].where(stages[0].doc_id.isin(list(keep))))


def test_toxicity_stage(spark, stages):
    s = toxicity.score(stages[1], toxicity_model(spark, SF, stages[1]))
    keep = {r["doc_id"] for r in s.where("predicted = 0").collect()}
    assert rows(stages[2]) == rows(stages[1].where(stages[1].doc_id.isin(list(keep))))


def test_near_copies_stage(stages):
    docs = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    keep = {d for d, n, c in classes(docs, 5, 8, 10) if not n or c == d}
    assert rows(stages[3]) == rows(stages[2].where(stages[2].doc_id.isin(list(keep))))


def test_decontaminate_stage(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, n, h, _ in spans([(r["doc_id"], r["text"]) for r in stages[3].collect()], items) if h and 20 * h >= n}
    assert rows(stages[4]) == rows(stages[3].where(~stages[3].doc_id.isin(list(bad))))


def test_pack_stage_and_run(spark, stages, tokenizer):  # noqa: F811
    from tabprobe.llm import packing
    from tabprobe.llm.queries import vocabulary
    docs = [(r["doc_id"], r["text"]) for r in stages[4].collect()]
    check(packing.pack(stages[4], *vocabulary()).collect(), docs, tokenizer)
    place = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert rows(P.run(spark, SF).select(place)) == rows(stages[5].select(place))
