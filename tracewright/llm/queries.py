"""The queries of the corpus operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann,
    collocations,
    conversations,
    decontamination,
    jaccard,
    language,
    ordinal,
    packing,
    pii,
    quality,
    sentencepieces,
    substrings,
    toxicity,
)

WORD_TOKENIZER, PIECE_MODEL = "word_bpe_49k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return ann.neighbours(rows, rows.where("vec_id % 100 = 0"), k=10)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(_table(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *counts, "base_failed", "kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encoding_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op8_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.quality_grades(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_digests(_table(spark, sf_dir, "documents"), width=50)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(_table(spark, sf_dir, "conversations"))
    return conversations.repair_digests(damaged, _table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ann,
        op2_quality,
        op3_toxicity,
        op4_packing,
        op5_jaccard,
        op6_sentencepiece,
        op7_language,
        op8_ordinal,
        op9_pii,
        op10_substrings,
        op11_collocations,
        op12_leaks,
        op13_conversations,
    )
}


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
