"""The queries of this subpackage, by name: each takes (spark, sf_dir), applies one operator to its whole table and returns the whole result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, hard_negatives, html_text, language_id, line_dedup, lm, packing, quality_model, quality_rules, resampling, simhash, topk, toxicity
from .common import spread, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(spread(table(spark, sf_dir, "documents")), BYTE_BPE)


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(spread(table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.apply_index(spread(docs), toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spread(table(spark, sf_dir, "documents")), WORD_BPE)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.apply_model(spread(docs), quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(spread(table(spark, sf_dir, "documents")))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(spread(docs), language_id.fit(docs))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "if(vec_id % 7 = 0, (label + 1) % 10, label) label", "embedding")
    return hard_negatives.mine(vectors, vectors.filter("vec_id % 50 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_lm": op2_lm,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_html_text": op5_html_text,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_topk": op10_topk,
    "op11_language_id": op11_language_id,
    "op12_resampling": op12_resampling,
    "op13_hard_negatives": op13_hard_negatives,
}

#: DuckDB SQL by query; a query that SQL cannot express is tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op8_line_dedup": line_dedup.SQL,
    "op10_topk": topk.SQL,
    "op12_resampling": resampling.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
