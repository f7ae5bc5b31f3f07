"""Retrieval-augmented answers: context, prompt and messages as one DataFrame query; the model is an injected callable."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.validation import trimmed
from . import search, vector_join

HISTORY, SESSION = 8, 16
BREAK = "\n\n---\n\n"

NOTHING_FOUND = 'You answer questions about the document "%s".\n\nThe document has nothing on this question. Say in one factual sentence that it is not in the document.\n'
GROUNDED = 'You answer questions about the document "%s" from the context below and nothing else.\n\nCite page numbers. If the context lacks the answer, say that it is not in the document. Be brief; do not guess.\n\nDOCUMENT CONTEXT:\n%s\n'
EXTRACT = "Transcribe the page image to Markdown. Keep headings, lists and tables; add nothing.\n"
TRANSLATE = "Translate the Markdown into %s. Keep its structure; return the translation alone.\n\n%s"


def page_text(original: Column, translated: Column) -> Column:
    """Translated text if there is any value, even an empty one, else the original."""
    return F.coalesce(translated, original, F.lit(""))


def context(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, context): the found pages by falling similarity, each under its number; pages without text are left out. found holds a few pages for each question."""
    body = page_text(F.col("original_markdown"), F.col("translated_markdown"))
    part = F.when(body != "", F.concat(F.lit("[Page "), F.col("page_number").cast("string"), F.lit("]\n"), trimmed(body)))
    rows = found.select(*by, F.struct((-F.col("similarity")).alias("order"), "page_id", part.alias("part")).alias("p"))
    return rows.groupBy(*by).agg(F.array_join(F.filter(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), lambda x: x.isNotNull()), BREAK).alias("context"))


def system_prompt(title: Column, text: Column) -> Column:
    return F.when(text == "", F.format_string(NOTHING_FOUND, title)).otherwise(F.format_string(GROUNDED, title, text))


def translate_prompt(language: Column, text: Column) -> Column:
    return F.format_string(TRANSLATE, language, text)


def last_messages(messages: DataFrame, n: int = HISTORY, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n messages of each conversation; rows stay rows, so one very long conversation is only sorted."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order), F.desc("role"), F.desc("text")))
    return messages.withColumn("_n", place).filter(F.col("_n") <= n).drop("_n")


def history(messages: DataFrame, n: int = HISTORY) -> DataFrame:
    """(conv_id, history): the last n messages in order, as an array of at most n."""
    kept = last_messages(messages, n)
    return kept.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("history"))


def build_messages(system: Column, past: Column, question: Column) -> Column:
    message = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    return F.concat(message("system", system), F.slice(past, F.greatest(F.lit(1), F.size(past) - HISTORY + 1), F.lit(HISTORY)), message("user", question))


def ask(pages: DataFrame, documents: DataFrame, document_id: str, question: str, vector: Sequence[float], past: DataFrame | None = None, conversation=None, limit: int = search.CONTEXT_PAGES, min_similarity: float = search.MIN_SIMILARITY) -> DataFrame:
    """(document_id, context, messages) for one question; an empty question is an error. past (conv_id, history) counts by its row of the conversation."""
    question = question.strip()
    if not question:
        raise ValueError("empty_question")
    asked = documents.filter(F.col("document_id") == document_id).select("document_id", F.lit(conversation).alias("conv_id"), F.lit(question).alias("question"))
    return ask_each(asked, pages, documents, document_id, vector, past, limit, min_similarity).select("document_id", "context", "messages")


def ask_each(asked: DataFrame, pages: DataFrame, documents: DataFrame, document_id: str, vector: Sequence[float], past: DataFrame | None = None, limit: int = search.CONTEXT_PAGES, min_similarity: float = search.MIN_SIMILARITY) -> DataFrame:
    """(document_id, conv_id, context, messages) for the questions (conv_id, question) of many conversations about one document that share a vector; blank questions are left out."""
    text = context(search.document_search(pages, document_id, vector, limit, min_similarity))
    about = documents.filter(F.col("document_id") == document_id).select("document_id", "title").join(F.broadcast(text))  # one row of at most `limit` pages
    rows = asked.select("conv_id", trimmed(F.col("question")).alias("question")).filter("question <> ''").withColumn("document_id", F.lit(document_id)).join(F.broadcast(about), "document_id")
    old = F.array().cast("array<struct<role:string,content:string>>")
    if past is not None:
        rows = rows.join(past.select("conv_id", "history"), "conv_id", "left")
        old = F.coalesce("history", old)
    return rows.select("document_id", "conv_id", "context", build_messages(system_prompt(F.col("title"), F.col("context")), old, F.col("question")).alias("messages"))


def ask_many(asked: DataFrame, pages: DataFrame, documents: DataFrame, past: DataFrame | None = None, limit: int = search.CONTEXT_PAGES, min_similarity: float = search.MIN_SIMILARITY) -> DataFrame:
    """(document_id, conv_id, context, messages) for questions (conv_id, question, document_id, vector), one a conversation, each about its own document with its own vector.

    Blank questions and those about unknown documents are left out; where a document has nothing similar, the context is empty and the prompt says so. Texts join after the
    few pages of each question are found.
    """
    rows = asked.select("conv_id", "document_id", "vector", trimmed(F.col("question")).alias("question")).filter("question <> ''").join(documents.select("document_id", "title"), "document_id")
    usable = pages.filter("extraction_status = 'completed' AND embedding IS NOT NULL").select("page_id", "document_id", F.col("embedding").alias("vector"))
    found = vector_join.nearest(rows.select(F.col("conv_id").alias("question"), "document_id", "vector"), usable, limit, min_similarity)
    shown = found.withColumnRenamed("question", "conv_id").join(pages.select("page_id", "page_number", "original_markdown", "translated_markdown"), "page_id")
    rows = rows.join(context(shown, ("conv_id",)), "conv_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    old = F.array().cast("array<struct<role:string,content:string>>")
    if past is not None:
        rows = rows.join(past.select("conv_id", "history"), "conv_id", "left")
        old = F.coalesce("history", old)
    return rows.select("document_id", "conv_id", "context", build_messages(system_prompt(F.col("title"), F.col("context")), old, F.col("question")).alias("messages"))


def answered(asked: DataFrame, model: Callable[[list[dict]], str]) -> DataFrame:
    """asked with answer: what the model says to each row's messages, trimmed and without fences; an empty answer is an error, null here. conv_id passes if there is one."""
    import re

    keys = [c for c in ("document_id", "conv_id") if c in asked.columns]
    kinds = dict(asked.dtypes)

    def run(batches):
        for batch in batches:
            out = []
            for messages in batch["messages"]:
                said = re.sub(r"\n?```\s*\Z", "", re.sub(r"\A```[^\n]*\n", "", (model([dict(m) if isinstance(m, dict) else m.asDict() for m in messages]) or "").strip())).strip()
                out.append(said or None)
            yield pd.DataFrame({**{c: batch[c] for c in keys}, "answer": out})

    return asked.select(*keys, "messages").mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", answer string")
