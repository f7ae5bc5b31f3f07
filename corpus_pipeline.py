"""From raw documents to packed training sequences: the stages, in order, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and other columns that docs may have.

Nulls, empty and very long texts, ties and repeated rows are as the operators' docstrings say: a null or empty text fails the rules and goes first; whole texts are read; of equal texts the near duplicates'
stage keeps one; rows with equal ids are judged each for itself. Empty documents give empty sequences, and without labels the classifier keeps everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import line_dedup, packing, quality_model, quality_rules, simhash
from lectern.llm.common import checkpointed, spread, table
from lectern.llm.queries import WORD_BPE


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows of the whole table, also from those that rules rejected."""
    model = quality_model.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_model.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go from every text."""
    return line_dedup.without_shared_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("line dedup", lines), ("near duplicates", near_duplicates), ("packing", pack)]

#: Stages are Python; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
