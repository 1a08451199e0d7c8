"""Training-corpus pipeline over ``documents``: each stage's result is written as Parquet and read again by the next.

quality (drops what the classifier rejects) -> near_duplicates (one document
of each class stays) -> repeated_passages (cut out of the texts) ->
decontamination (documents that overlap with a benchmark item go) -> packing
(one row per piece of a token sequence).  All but the last return the columns
of ``documents``.

Stage results go below the folder named by ``spark.checkpoint.dir``, in a new
folder per run, so every executor can read them and a rerun meets no leftovers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from panelcast.llm import chunk_dedup, order_minhash, pu_quality, spaced_seed, swap_packing
from panelcast.llm.common import table
from panelcast.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pu_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.keep_one_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chunk_dedup.dedup_texts(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spaced_seed.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return swap_packing.pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Fitted, sketched and packed stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        place = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
