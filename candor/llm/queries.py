"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from candor.llm import ann, compaction, decontam, langid, line_dedup, ngram_join, packing, quality, repeats, window_dedup
from candor.llm.shared import small_batches


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.dedup_windows(_read(spark, sf_dir, "documents"), texts=False)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer or tokenizer_path())


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_read(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_decisions(_read(spark, sf_dir, "documents"), short=True)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(_read(spark, sf_dir, "documents"))


def op3_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_posting_list_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.compacted_documents(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language_id, op2_ngram_jaccard_join, op3_quality_mil, op4_suffix_array_dedup, op5_substring_dedup, op6_posting_list_ann, op7_best_fit_packing, op8_sharding, op9_decontamination, op10_line_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The others can't be written in SQL: learned classifiers (1, 3), greedy packing (7), approximate search (6), and
    edit distances, of which all pairs would be needed (10)."""
    return {
        "op2_ngram_jaccard_join": ngram_join.ORACLE_SQL,
        "op4_suffix_array_dedup": repeats.ORACLE_SQL,
        "op5_substring_dedup": window_dedup.ORACLE_SQL,
        "op8_sharding": compaction.ORACLE_SQL,
        "op9_decontamination": decontam.ORACLE_SQL,
    }
