"""Corpus pipeline: from raw documents to packed training sequences, each stage written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return
the columns of ``documents``.

1. quality: documents that the quality classifier rejects go.
2. near_duplicates: of every group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays.
3. decontamination: documents that hold a benchmark item, within the edit budget, go.
4. pii: personal data in the texts is replaced by its kind.
5. packing: the texts are packed into sequences of 2048 tokens; a row a piece.

Null texts are empty documents, and an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quiver.llm import decontam, ngram_join, packing, pii, quality
from quiver.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.default_vocabulary())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

# The classifier, the edit distance and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
