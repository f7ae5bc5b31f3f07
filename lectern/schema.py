"""The data model: documents and their pages, with the checks that a store's constraints would make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The statuses of documents and of a page's three steps.
DOCUMENT_STATUSES = ("uploading", "queued", "extracting", "processing", "completed", "error")
PAGE_STATUSES = ("pending", "processing", "completed", "error")

DIMENSIONS = 1024

DOCUMENTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("original_filename", T.StringType(), False),
        T.StructField("total_pages", T.IntegerType()),
        T.StructField("status", T.StringType(), False),
        T.StructField("target_language", T.StringType(), False),
        T.StructField("error_message", T.StringType()),
        T.StructField("inserted_at", T.TimestampNTZType(), False),
        T.StructField("updated_at", T.TimestampNTZType(), False),
    ]
)

PAGES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("document_id", T.StringType(), False),
        T.StructField("page_number", T.IntegerType(), False),
        T.StructField("image_path", T.StringType()),
        T.StructField("original_markdown", T.StringType()),
        T.StructField("translated_markdown", T.StringType()),
        T.StructField("extraction_status", T.StringType(), False),
        T.StructField("translation_status", T.StringType(), False),
        T.StructField("embedding_status", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False)),
    ]
)

MESSAGE = T.StructType([T.StructField("role", T.StringType(), False), T.StructField("content", T.StringType(), False)])


def violations(documents: DataFrame, pages: DataFrame, dimensions: int | None = DIMENSIONS) -> DataFrame:
    """(rule, n) for every rule that some rows break: statuses, uniqueness, references and the length of vectors."""
    bad_status = lambda df, col, allowed: df.filter(~F.coalesce(F.col(col).isin(*allowed), F.lit(False))).agg(F.count("*").alias("n")).select(F.lit(f"{col} of {df is documents and 'documents' or 'pages'}").alias("rule"), "n")
    twice = lambda df, cols, rule: df.groupBy(*cols).count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    found = [
        bad_status(documents, "status", DOCUMENT_STATUSES),
        *(bad_status(pages, c, PAGE_STATUSES) for c in ("extraction_status", "translation_status", "embedding_status")),
        twice(documents, ["id"], "documents.id is unique"),
        twice(pages, ["document_id", "page_number"], "one page of a number in a document"),
        pages.join(documents, pages.document_id == documents.id, "left_anti").agg(F.count("*").alias("n")).select(F.lit("every page has a document").alias("rule"), "n"),
    ]
    if dimensions:
        found.append(pages.filter(F.size("embedding") != dimensions).agg(F.count("*").alias("n")).select(F.lit("length of embedding").alias("rule"), "n"))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.filter("n > 0")
