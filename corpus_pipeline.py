"""The corpus pipeline: quality rules, exact and near deduplication, substring deduplication, packing.

Every stage is one operator of ``almanac.llm``. It gets the rows its predecessor kept, written as
Parquet and read again, and returns the columns of ``documents``; the last returns packed pieces.
Rows with nulls, empty texts or repeats are handled as each operator defines.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from almanac.llm import exact_dedup, jaccard_join, packing, recompression, repetition
from almanac.llm.util import documents, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, one with the largest doc_id."""
    return exact_dedup.drop_copies(docs, one_row=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one with the smallest doc_id. Near copies
    share 0.8 or more of their sets of five-word shingles; op7's 4 words and 0.85 hold for op7 alone."""
    return jaccard_join.one_of_each(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word passages that start in an earlier one."""
    return recompression.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), together=TOGETHER, cached=CACHED)


#: Bytes of text and cached words of a worker of ``packed``: less than packing's own, as the executors'
#: heaps have grown in the stages before.
TOGETHER, CACHED = 1 << 20, 200_000

STAGES = [
    ("quality_rules", quality_rules),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("packed", packed),
]

#: SQL can't express the tokenizer or the suffix sort; tests/llm/test_pipeline.py
#: compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
