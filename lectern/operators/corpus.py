"""Reads, aggregates and writes over documents and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DONE = "completed"

#: Pages whose work is not over: neither translated nor failed at extraction.
NOT_DONE = "translation_status <> 'completed' AND extraction_status <> 'error'"


def scan_documents(documents: DataFrame, by: str = "inserted_at", direction: str = "desc") -> DataFrame:
    return documents.orderBy(F.desc(by) if direction == "desc" else F.asc(by), "document_id")


def in_progress(documents: DataFrame) -> DataFrame:
    """Documents that are queued or being processed, oldest first; what recovery takes up again."""
    return documents.filter(F.col("status").isin("processing", "queued")).orderBy("inserted_at", "document_id")


def pages_of(pages: DataFrame, document_id: str) -> DataFrame:
    return pages.filter(F.col("document_id") == document_id).orderBy("page_number")


def point(df: DataFrame, required: bool = False, **keys) -> DataFrame:
    """The rows with the given keys; with required, an error if there are none or several."""
    for column, value in keys.items():
        df = df.filter(F.col(column) == value)
    if required:
        n = df.limit(2).count()
        if n != 1:
            raise LookupError(f"{n or 'no'} rows with {keys}" if n < 2 else f"several rows with {keys}")
    return df


def _progress_sums(pages: DataFrame) -> DataFrame:
    done = lambda c: F.sum(F.when(F.col(c) == DONE, 1).otherwise(0))
    return pages.groupBy("document_id").agg((done("extraction_status") + done("translation_status")).alias("done"))


def with_progress(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """documents with progress, the percentage of steps done of two steps for each of total_pages; 0 without pages or total."""
    rate = F.col("done") / (F.col("total_pages") * 2) * 100
    return documents.join(_progress_sums(pages), "document_id", "left").withColumn("progress", F.when(F.col("done").isNull() | F.col("total_pages").isNull() | (F.col("total_pages") == 0), 0.0).otherwise(rate)).drop("done")


def completion(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, all_completed); a document without pages counts as completed."""
    open_pages = pages.groupBy("document_id").agg(F.sum(F.when(F.expr(NOT_DONE), 1).otherwise(0)).alias("open"))
    return documents.select("document_id").join(open_pages, "document_id", "left").select("document_id", (F.coalesce("open", F.lit(0)) == 0).alias("all_completed"))


def next_page(pages: DataFrame, step: str) -> DataFrame:
    """For each document the first page that waits for a step; min over a struct, so nothing is sorted."""
    waiting = {"extraction": "extraction_status = 'pending'", "translation": "extraction_status = 'completed' AND translation_status = 'pending'"}[step]
    return pages.filter(waiting).groupBy("document_id").agg(F.min(F.struct("page_number", "page_id")).alias("first")).select("document_id", "first.page_number", "first.page_id")


def embeddings_ready(documents: DataFrame, pages: DataFrame) -> DataFrame:
    ready = pages.filter("embedding_status = 'completed' AND embedding IS NOT NULL").select("document_id").distinct().withColumn("_r", F.lit(True))
    return documents.select("document_id").join(ready, "document_id", "left").select("document_id", F.coalesce("_r", F.lit(False)).alias("ready"))


def with_thumbnail(documents: DataFrame, pages: DataFrame) -> DataFrame:
    first = pages.filter("page_number = 1").select("document_id", "image_path")
    return documents.select("document_id").join(first, "document_id", "left").select("document_id", F.col("image_path").isNotNull().alias("has_thumbnail"))


def preload(documents: DataFrame, pages: DataFrame, columns: tuple[str, ...] = ("page_number", "page_id", "extraction_status", "translation_status")) -> DataFrame:
    """documents with their pages as an ordered array of structs. A document's pages are one value, so only small columns belong here."""
    nested = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("pages"))
    return documents.join(nested, "document_id", "left").withColumn("pages", F.coalesce("pages", F.array().cast(nested.schema["pages"].dataType)))


def dashboard(documents: DataFrame, pages: DataFrame, by: str = "inserted_at", direction: str = "desc") -> DataFrame:
    counted = pages.groupBy("document_id").agg(F.count("*").alias("n_pages"))
    return scan_documents(with_progress(documents, pages).join(counted, "document_id", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0))), by, direction)


# --- rules on rows ---


def can_process_page(extraction: Column, translation: Column) -> Column:
    return F.coalesce(extraction.isin("pending", "error") | ((extraction == DONE) & (translation != DONE)), F.lit(False))


def can_process_document(status: Column) -> Column:
    return status.isin("queued", "extracting")


def can_reprocess(extraction: Column, translation: Column) -> Column:
    return F.coalesce(extraction.isin(DONE, "error") | (translation == "error"), F.lit(False))


def shows_content(extraction: Column, translation: Column, original: Column, translated: Column, show_original: Column) -> Column:
    return F.when(show_original, (extraction == DONE) & original.isNotNull()).otherwise((translation == DONE) & translated.isNotNull())


def embedding_text(original: Column, translated: Column, prefer_original: bool = True) -> Column:
    return original if prefer_original else F.coalesce(translated, original)


def view_state(extraction: Column, translation: Column, original: Column, translated: Column, show_original: Column) -> Column:
    """The independent flags that decide what a viewer shows."""
    return F.struct(
        (extraction == "processing").alias("extracting"),
        (~show_original & (extraction == DONE) & (translation == "processing")).alias("translating"),
        (extraction == "pending").alias("pending"),
        ((extraction == "error") | (translation == "error")).alias("error"),
        shows_content(extraction, translation, original, translated, show_original).alias("content"),
    )


# --- writes, as the tables that they leave ---


def inserted(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def bulk_pages(pages: DataFrame, document_id: str, images: DataFrame, first_id: int) -> DataFrame:
    """pages with a new pending page for each row of images (page_number, image_path), numbered from 1; ids follow the page numbers."""
    new = images.select(
        (F.col("page_number") + first_id - 1).cast("long").alias("page_id"), F.lit(document_id).alias("document_id"), F.col("page_number"), "image_path", *(F.lit("pending").alias(c) for c in ("extraction_status", "translation_status", "embedding_status"))
    )
    return pages.unionByName(new, allowMissingColumns=True)


def updated(table: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """table with the values of changes in place, nulls too; keys that the table lacks change nothing.

    Of several changes of a key the last by order counts, or the greatest of their values if there is none.
    """
    columns = [c for c in changes.columns if c not in (key, order)]
    values = F.struct(*columns)
    new = changes.groupBy(key).agg((F.max_by(values, order) if order else F.max(values)).alias("_new"))
    return table.join(new, key, "left").select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))


def deleted(documents: DataFrame, pages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the documents of ids; their pages go too."""
    return documents.join(ids, "document_id", "left_anti"), pages.join(ids, "document_id", "left_anti")


def reset_rows(pages: DataFrame, which: Column) -> DataFrame:
    """The chosen pages as new: texts and vectors gone, all steps pending."""
    gone = {c: F.when(which, F.lit(None)).otherwise(F.col(c)) for c in ("original_markdown", "translated_markdown", "embedding")}
    return pages.withColumns(gone | {c: F.when(which, "pending").otherwise(F.col(c)) for c in ("extraction_status", "translation_status", "embedding_status")})


def retried(pages: DataFrame, which: Column) -> DataFrame:
    """The chosen pages' steps pending again, texts retained."""
    return pages.withColumns({c: F.when(which, "pending").otherwise(F.col(c)) for c in ("extraction_status", "translation_status")})


def marked_failed(pages: DataFrame, which: Column) -> DataFrame:
    return pages.withColumn("extraction_status", F.when(which, "error").otherwise(F.col("extraction_status")))


def backfilled(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """pages with the text-search configuration of their document's language: an update from a join."""
    from ..functions.labels import fts_config

    return pages.join(documents.select("document_id", "target_language"), "document_id", "left").withColumn("fts_config", fts_config(F.col("target_language"))).drop("target_language")
