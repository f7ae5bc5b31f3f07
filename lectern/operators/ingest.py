"""Ingest: from uploaded files to completed documents, with injected tools and models.

Each step is a table made from the one before, so a run is a chain of DataFrames: pages of files, their texts, vectors and translations, and the
states that these leave. Failures stay with their page. What a foreign call returns is written once, so that no call is made twice for a row and all that follows
agrees on what it said.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..plans.keep import kept
from ..sources import files as sources
from ..sources import models
from . import corpus, lifecycle


def ingest(
    uploads: DataFrame,
    extract: Callable[[bytes], Iterator[bytes]],
    read: Callable[[str], str],
    translate: Callable[[str], str],
    embed: Callable[[str], list[float]],
    convert: Callable[[bytes], bytes] | None = None,
    attempts: int = 3,
    sleep: Callable[[float], None] = lambda s: None,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pages) of uploads (document_id, filename, target_language, path, content)."""
    routed = uploads.withColumn("route", labels.format_route(F.col("filename")))
    ready = routed.filter("route = 'pdf'").select("path", "content")
    failed = routed.filter("route = 'unsupported'").select("path", F.lit("unsupported format").alias("reason"))
    if convert is not None:
        done = kept(sources.converted(routed.filter("route = 'convertible'"), convert))
        ready = ready.unionByName(done.filter("error IS NULL").select("path", "content"))
        failed = failed.unionByName(done.filter("error IS NOT NULL").select("path", F.col("error").alias("reason")))
    how = {"attempts": attempts, "sleep": sleep}
    pages = kept(sources.extracted(ready, extract)).join(uploads.select("path", "document_id"), "path").withColumn("page_id", F.concat_ws("/", "document_id", "page_number"))
    texts = kept(models.read_images(pages, "page_id", "content", read, **how)).select("page_id", F.col("value").alias("original_markdown"), F.col("error").alias("extraction_error"))
    pages = pages.select("page_id", "document_id", "page_number").join(texts, "page_id")
    vectors = kept(models.embedded(pages.filter("extraction_error IS NULL"), "page_id", "original_markdown", embed, **how)).select("page_id", F.col("value").alias("embedding"), F.col("error").alias("embedding_error"))
    prompts = pages.filter("extraction_error IS NULL AND original_markdown <> ''")
    translated = kept(models.generated(prompts, "page_id", "original_markdown", translate, **how)).select("page_id", F.col("value").alias("translated_markdown"), F.col("error").alias("translation_error"))
    pages = pages.join(vectors, "page_id", "left").join(translated, "page_id", "left")
    state = lambda failed_, gone: F.when(gone, "pending").when(failed_.isNotNull(), "error").otherwise("completed")
    no_text = F.col("extraction_error").isNotNull()
    pages = pages.select(
        "page_id", "document_id", "page_number", "original_markdown", "translated_markdown", "embedding",
        state(F.col("extraction_error"), F.lit(False)).alias("extraction_status"),
        state(F.col("translation_error"), no_text).alias("translation_status"),
        state(F.col("embedding_error"), no_text).alias("embedding_status"),
    )
    counted = pages.groupBy("document_id").agg(F.count("*").cast("int").alias("total_pages"))
    documents = routed.join(counted, "document_id", "left").join(failed, "path", "left")
    documents = documents.select("document_id", labels.title_of(F.col("filename")).alias("title"), F.col("filename").alias("original_filename"), "target_language", "total_pages", F.col("reason").alias("error_message"), F.when(F.col("reason").isNotNull(), "error").otherwise("processing").alias("status"))
    return lifecycle.completed_documents(documents, corpus.completion(documents, pages)), pages
