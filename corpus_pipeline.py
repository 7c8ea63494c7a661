"""A corpus from documents: toxicity, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Clean documents stay: the first three stages drop toxic documents and copies, mixing only adds copies (its rates are
1 or more), packing places every piece.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexiweave.llm import exact_dedup, mixing, packing, simhash, toxicity
from lexiweave.llm.common import checkpoint_folder, release, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = mixing.fit_classifier(docs, table(spark, sf_dir, "labels"))
    return mixing.remix(docs, model, {"high": 0.90, "low": 0.10})


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]

#: Stages with trained models and sequential packing are beyond SQL; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each result written as Parquet under the checkpoint folder and read again."""
    docs, base = table(spark, sf_dir, "documents"), f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{i}")
            docs = spark.read.parquet(f"{base}/{i}")
            release(spark)
    return docs
