"""Registered queries of this package and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from keysweep.llm import languages
from keysweep.llm.covering import near_duplicates
from keysweep.llm.exact import exact_groups
from keysweep.llm.lexical import SEARCH_SQL, search
from keysweep.llm.licenses import known_digests, licenses, licenses_sql
from keysweep.llm.packing import pack
from keysweep.llm.phrases import COLLOCATIONS_SQL, collocations
from keysweep.llm.pseudonyms import pseudonymise
from keysweep.llm.recompression import without_repeats
from keysweep.llm.sharding import shards
from keysweep.llm.suffixes import without_earlier
from keysweep.llm.tiling import decontaminate
from keysweep.llm.toxicity import fit, sample, score


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Key of the registered query alone; real keys are secrets of their users.
DEMO_KEY = "registered query"


def op1_license_scan(spark, sf_dir):
    found = licenses(_table(spark, sf_dir, "documents"), known_digests(spark))
    return found.withColumnRenamed("id", "doc_id")


def op2_recompression_dedup(spark, sf_dir):
    done = without_repeats(_table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("digest").alias("kept_sha256"))


def op3_pii_pseudonyms(spark, sf_dir):
    return pseudonymise(_table(spark, sf_dir, "documents"), DEMO_KEY).withColumnRenamed("id", "doc_id")


def op4_exact_dedup(spark, sf_dir):
    groups = exact_groups(_table(spark, sf_dir, "documents"), digest_all=True)
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op5_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = fit(sample(_table(spark, sf_dir, "labels"), docs))
    return score(docs, model).withColumnRenamed("id", "doc_id")


def op6_packing(spark, sf_dir):
    pieces = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "context", "step_group")


def op7_simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op8_suffix_array_dedup(spark, sf_dir):
    done = without_earlier(_table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("digest").alias("kept_sha256"))


def op9_sharding(spark, sf_dir):
    placed = shards(_table(spark, sf_dir, "documents"), n_shards=40)
    return placed.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
                         "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")


def op10_benchmark_decontamination(spark, sf_dir):
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def op11_phrase_collocations(spark, sf_dir):
    return collocations(_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark, sf_dir):
    found = search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"item": "item_id", "id": "doc_id"})


def op13_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return languages.languages(docs, languages.fit(languages.sample(docs))).withColumnRenamed("id", "doc_id")


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {q.__name__: q for q in (
    op1_license_scan, op2_recompression_dedup, op3_pii_pseudonyms, op4_exact_dedup, op5_toxicity, op6_packing, op7_simhash_near_dedup,
    op8_suffix_array_dedup, op9_sharding, op10_benchmark_decontamination, op11_phrase_collocations, op12_lexical_search, op13_language_id, pipeline,
)}

SQL = {
    "op1_license_scan": licenses_sql(),
    "op4_exact_dedup": r"""
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY t)""",
    "op11_phrase_collocations": COLLOCATIONS_SQL,
    "op12_lexical_search": SEARCH_SQL,
}
