"""The corpus pipeline: quality rules, language ID, deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of documents; the
last returns the packing plan. A stage's result is written as Parquet and read by the next.

Defined cases: null or blank text goes with the quality rules; a null lang is judged by script and not
learned from; a null source is a source of its own; of documents without doc_id one of each near-duplicate
group stays; repeated rows are one group; extra columns, whatever their names, stay up to the last stage; an
empty table, or one that a stage empties, gives an empty plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.llm import language_id, mixing, ngram_join, packing, quality_rules
from wavegrid.llm._store import materialise


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learn = docs.where(language_id.fold(F.col("doc_id"), 3) != 1)
    return language_id.keep_clear(docs, language_id.train(learn))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, width=5, threshold=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", good),
    ("language_id", in_a_language),
    ("ngram_join", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

#: Tokeniser, classifier and set join are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
