"""Documents to packed training sequences, in five stages, each one of the corpus operators.

Language identification (documents without a language go), exact duplicates, near duplicates (word 5-grams,
Jaccard 0.8), mixing sources to target weights, and best-fit packing. Every stage returns the columns of
`documents` but the last, which returns the packed pieces. A stage reads all its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candor.llm import exact_dedup, jaccard, language, mixing, packing
from candor.llm.common import written
from candor.llm.queries import table, tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), 2048, 0)


STAGES = [
    ("language", identify_language),
    ("exact_copies", drop_exact_copies),
    ("near_copies", drop_near_copies),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

#: Neither the parse against suffix automata nor the tokenizer can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
