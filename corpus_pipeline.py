"""A training corpus in five stages over the table documents; each stage is written as Parquet and reread as the next one's docs.

1. language: documents without a language (no text, no letter, or of no learned language: langid.MIN_EVIDENCE) go.
2. near_duplicates: of each class of documents that n-gram Jaccard links connect, the one with the least id stays.
3. repeated_passages: bytes covered by a 50-byte string that also starts in a document with a smaller id are cut out of
   the text (n_chars is counted anew); every document stays, even if nothing is left of its text.
4. decontaminate: documents that hold a benchmark item go.
5. mix: all that is left is mixed; the result has each document's size, its source's target, the words taken and their
   training positions.

Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns: as each operator's module says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from driftlab.llm import decontaminate, jaccard, langid, mixing, suffix_dedup
from driftlab.llm.common import shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminate", decontamination),
    ("mix", mix),
]

#: SQL can't express the trained model, the similarity joins and the suffix arrays; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
