"""A pipeline over documents: each stage calls one operator of candor.llm, works on all that the stage before kept,
and hands on a table.

1. language ID: documents that the classifier rejects go: those whose language can't be told (no letter, or no text)
   or for which it finds two languages about equally likely.
2. line dedup: lines that stand earlier, equal or within two edits, are cut; documents of which nothing is left go.
3. n-gram Jaccard join: of documents linked by word 5-grams at a similarity of 0.8, the smallest doc_id stays.
4. benchmark decontamination: documents that hold ten consecutive words of a benchmark item (or a shorter item whole) go.
5. best-fit packing: pieces of at most 2048 tokens with their place in a sequence.

Stages 1 to 4 return the columns of documents. A null in any column is kept as it is; rows without a doc_id pass the
stages untouched. Every stage accepts an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.llm import decontam, langid, line_dedup, ngram_join, packing
from candor.llm.queries import tokenizer_path
from candor.llm.shared import shared_folder, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return langid.keep_known(docs.select(COLUMNS), ambiguous=False)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return line_dedup.dedup_lines(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.dedup(docs.select(COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each writes its table to the shared folder, and the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        made.write.parquet(f"{place}/{k}")
        docs = spark.read.schema(made.schema).parquet(f"{place}/{k}")
    return docs


#: Learned classifiers, edit distances and packing can't be written in SQL; tests/llm/test_pipeline.py holds the stages
#: against brute force instead.
ORACLE_SQL = None
