"""Logical documents and pages over the driver's tables, so that every query has data: the same rules in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EXTRACTION = "CASE doc_id % 19 WHEN 0 THEN 'error' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing' ELSE 'completed' END"
TRANSLATION = f"CASE WHEN {EXTRACTION} <> 'completed' THEN 'pending' WHEN doc_id % 7 = 0 THEN 'error' WHEN doc_id % 11 = 0 THEN 'pending' ELSE 'completed' END"
STATUS = "CASE source WHEN 'src3' THEN 'processing' WHEN 'src4' THEN 'queued' WHEN 'src6' THEN 'extracting' WHEN 'src8' THEN 'uploading' WHEN 'src9' THEN 'error' ELSE 'completed' END"

#: Inputs of validators, one row for each document, with every kind of fault.
INPUTS = """doc_id AS id,
CASE doc_id % 8 WHEN 0 THEN '.hidden' WHEN 1 THEN source || '.pdf' WHEN 2 THEN 'a<b' || CAST(doc_id AS VARCHAR(20)) || '.pdf' WHEN 3 THEN repeat('x', 260)
  WHEN 4 THEN '../../etc/passwd' WHEN 5 THEN 'My file..' || CAST(doc_id AS VARCHAR(20)) || '  v1.docx' WHEN 6 THEN NULL ELSE 'name_' || CAST(doc_id AS VARCHAR(20)) || '-x__y.rtf' END AS filename,
CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/rtf' WHEN 2 THEN 'image/png' WHEN 3 THEN NULL ELSE 'application/msword' END AS content_type,
CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id * 500000 END AS size,
CASE doc_id % 6 WHEN 0 THEN lang WHEN 1 THEN ' ' || upper(lang) || ' ' WHEN 2 THEN 'xx' WHEN 3 THEN NULL WHEN 4 THEN 'pl' ELSE '' END AS language,
CASE doc_id % 7 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE ' Title ' || CAST(doc_id AS VARCHAR(20)) || ' ' END AS title,
CASE doc_id % 6 WHEN 0 THEN 'ab' WHEN 1 THEN text WHEN 2 THEN source || ' ' || lang WHEN 3 THEN 'x <script> y' WHEN 4 THEN NULL ELSE '  ' || lang || ' ' END AS query,
CASE doc_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' WHEN 4 THEN 'processing' ELSE NULL END AS step,
text, lang, source"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    numbered = docs.withColumn("page_number", F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id")))
    return (
        numbered.join(vectors, numbered.doc_id == vectors.vec_id, "left")
        .withColumn("extraction_status", F.expr(EXTRACTION))
        .withColumn("translation_status", F.expr(TRANSLATION))
        .selectExpr(
            "doc_id AS page_id",
            "source || '-' || lang AS document_id",
            "page_number",
            "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 'documents/' || source || '-' || lang || '/pages/page_' || page_number || '.png' END AS image_path",
            "text AS original_markdown",
            "CASE WHEN translation_status = 'completed' THEN text END AS translated_markdown",
            "extraction_status",
            "translation_status",
            "CASE WHEN embedding IS NULL THEN 'pending' ELSE 'completed' END AS embedding_status",
            "embedding",
        )
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("total_pages"), F.min("doc_id").alias("first"))
    return groups.selectExpr(
        "source || '-' || lang AS document_id",
        "'Volume ' || substr(source, 4) || ' (' || lang || ')' AS title",
        "source || '.pdf' AS original_filename",
        "CASE WHEN source = 'src10' THEN NULL ELSE total_pages END AS total_pages",
        f"{STATUS} AS status",
        "lang AS target_language",
        "CASE WHEN source = 'src9' THEN 'HTTP 500 error' END AS error_message",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(first AS INT)) AS inserted_at",
    )


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*_columns(INPUTS))


def _columns(text: str) -> list[str]:
    """The select list cut at its commas outside parentheses."""
    out, depth, start, quoted = [], 0, 0, False
    for k, c in enumerate(text):
        quoted ^= c == "'"
        if not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                out.append(text[start:k])
                start = k + 1
    return [*out, text[start:]]


#: The same in DuckDB, as common table expressions to put before a query.
PAGES_SQL = f"""w_pages AS (
  SELECT doc_id AS page_id, source || '-' || lang AS document_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id)::INT AS page_number,
    CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 'documents/' || source || '-' || lang || '/pages/page_' || row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) || '.png' END AS image_path,
    text AS original_markdown, CASE WHEN {TRANSLATION} = 'completed' THEN text END AS translated_markdown,
    {EXTRACTION} AS extraction_status, {TRANSLATION} AS translation_status,
    CASE WHEN embedding IS NULL THEN 'pending' ELSE 'completed' END AS embedding_status, embedding
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"""

DOCUMENTS_SQL = f"""w_documents AS (
  SELECT source || '-' || lang AS document_id, 'Volume ' || substr(source, 4) || ' (' || lang || ')' AS title, source || '.pdf' AS original_filename,
    CASE WHEN source = 'src10' THEN NULL ELSE count(*) END AS total_pages, {STATUS} AS status, lang AS target_language,
    CASE WHEN source = 'src9' THEN 'HTTP 500 error' END AS error_message,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(min(doc_id)) AS inserted_at
  FROM documents GROUP BY source, lang)"""

INPUTS_SQL = f"w_inputs AS (SELECT {INPUTS} FROM documents)"

BOTH = f"WITH {PAGES_SQL}, {DOCUMENTS_SQL} "
ONLY_PAGES = f"WITH {PAGES_SQL} "
ONLY_DOCUMENTS = f"WITH {DOCUMENTS_SQL} "
ONLY_INPUTS = f"WITH {INPUTS_SQL} "
