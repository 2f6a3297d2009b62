"""The corpus pipeline: from documents to packed sequences of tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of documents: language ID drops documents that share no n-gram with any language profile, the n-gram join keeps one document
of each group of near copies, decontamination drops documents that hold a benchmark item, and the privacy stage
replaces personal data in the text. The last gives a row per piece of a packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowgraph.llm import bpe, decontaminate, language_id, ngram_join, packing, pii_crf
from flowgraph.llm.common import read, stored

#: The stages use no SQL's operations alone; tests hold them against brute force.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranked = language_id.learn(language_id.train_split(docs))
    return language_id.recognised(docs, ranked)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_crf.redact(docs, pii_crf.learn(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, bpe.default_path())


STAGES = [
    ("language_id", languages),
    ("ngram_join", near_copies),
    ("decontamination", benchmark_leaks),
    ("pii_crf", personal_data),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
