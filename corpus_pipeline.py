"""A training corpus from the table documents: toxic documents, near copies, long repeats and benchmark passages go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm.decontaminate import drop_contaminated
from pointloom.llm.jaccard import keep_one
from pointloom.llm.packing import packed_digest
from pointloom.llm.substrings import PASSAGES, remove_repeats
from pointloom.llm.toxicity import drop_toxic
from pointloom.session import cut, prepare, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.7 or more."""
    prepare(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    prepare(spark)
    return keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words (PASSAGES) that stand more than once; documents stay, if empty."""
    prepare(spark)
    return remove_repeats(docs, strings=PASSAGES)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share ten consecutive words with a benchmark item."""
    prepare(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids with their places in packed sequences."""
    prepare(spark)
    return packed_digest(docs)


STAGES = [
    ("toxicity", toxicity),
    ("n_gram_jaccard_join", near_copies),
    ("suffix_array_dedup", repeats),
    ("benchmark_decontamination", benchmark_passages),
    ("best_fit_packing", packing),
]

#: Trees, sorting and tokenization can't be told in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is cut in the checkpoint folder before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
