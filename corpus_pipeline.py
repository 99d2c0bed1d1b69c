"""From documents to packed training sequences: toxicity, exact and near copies, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``docs``, and each
works on all that the one before it kept. Null and empty texts are clean documents, copies of each other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keysweep.llm.covering import without_near_duplicates
from keysweep.llm.exact import without_copies
from keysweep.llm.packing import pack
from keysweep.llm.tiling import decontaminate
from keysweep.llm.toxicity import fit, sample, score
from keysweep.plans.store import stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go; it is fitted on a bounded sample of the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(sample(labels, docs)), keep=True)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash fingerprints (three-word shingles, at most two bits apart) the one with the smallest id stays."""
    return without_near_duplicates(docs, radius=2, words=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of several context sizes."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("packing", packing)]

#: SQL has no counterpart of the model, the near copies and the tokenizer; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each one written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
