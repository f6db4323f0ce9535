"""From raw documents to packed sequences: quality, near duplicates, repeated passages, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import jaccard, packing, pii, quality, substrings
from tracewright.llm.queries import WORD_TOKENIZER
from tracewright.llm.text import unused
from tracewright.session import scratch_path

#: Near duplicates: shingles of five words, and a similarity of 0.8 or more.
SHINGLE_WORDS, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Rows without an id are judged like others, by id and text together."""
    key = unused(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    judged = quality.quality_rules(keyed.select(F.col(key).alias("doc_id"), "text", "lang"))
    kept = judged.where("kept").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(kept, key, "left_semi").drop(key)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near-duplicate links hold together: the one with the smallest id."""
    found = jaccard.jaccard_components(docs, SHINGLE_WORDS, PERCENT)
    stays = found.where("component_id is null or doc_id = component_id").select("doc_id").distinct()
    same = docs["doc_id"].eqNullSafe(stays["doc_id"])
    return docs.join(stays, same, "left_semi").dropDuplicates(["doc_id", "text"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of fifty words that an earlier one has; those left without words go."""
    return substrings.remove_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Tokens and fitted fields are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each on the written table of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{scratch_path(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
