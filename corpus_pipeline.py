"""The corpus pipeline over ``documents``: STAGES in order.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents. Their result is
written as Parquet and read again between stages (the shared checkpoint folder
holds it), so a lost executor never repeats an earlier stage.

quality       rows that the quality classifier rejects go
toxicity      rows judged toxic go
near_copies   one row of each class of near copies stays (five-word shingles, similarity 0.8)
decontaminate rows contaminated with benchmark passages go
pack          the pieces of sequences of 2048 ids, with their ids and a checksum
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.llm import decontaminate, packing, quality, sigtree, toxicity
from tabprobe.llm.queries import toxicity_model, vocabulary
from tabprobe.session import ensure_checkpoint_dir, table


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of the documents it gets, never from held-out ones."""
    return toxicity.keep_clean(docs, toxicity_model(spark, sf_dir, docs))


def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sigtree.first_of_each(docs, 5, 8, 10)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, *vocabulary()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality", stage_quality),
    ("toxicity", stage_toxicity),
    ("near_copies", stage_near_copies),
    ("decontaminate", stage_decontaminate),
    ("pack", stage_pack),
]
#: learned stages have no SQL twin; tests compare the rows with each stage's brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
