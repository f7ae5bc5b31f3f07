"""Hybrid and document-scoped search.

Pages have page_id, document_id, page_number, image_path, original_markdown, translated_markdown, extraction_status, embedding; documents have document_id, title,
status, target_language. Ties are broken by page_id everywhere. Ranking branches carry ids and scores alone; texts join after the limit.

Originals are analysed in the simple configuration, translations in the one of their document's language. Pages may have these lexemes as columns (`indexed`), else they are
made on the way. Scores, a few numbers for each page, are written once before they are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, sanitizing, text, vectors
from ..plans.keep import kept
from ..plans.rank import best, deepest, global_row_number, ranks_by_counting

RRF_K, FLOOR, PAGE_SIZE = 60, 0.01, 20
CONTEXT_PAGES, MIN_SIMILARITY = 3, 0.35
SNIPPET = 200


def searchable(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages whose text is extracted, of completed documents, with the document's language. Documents are few beside pages, but Spark decides by size."""
    return pages.filter("extraction_status = 'completed'").join(documents.filter("status = 'completed'").select("document_id", "target_language"), "document_id")


def semantic_scores(pages: DataFrame, documents: DataFrame, query: Sequence[float]) -> DataFrame:
    """(page_id, document_id, semantic_score) of all searchable pages with a vector; zero vectors take no part."""
    found = searchable(pages.filter("embedding IS NOT NULL"), documents)
    return found.select("page_id", "document_id", vectors.cosine(F.col("embedding"), query).alias("semantic_score")).filter("semantic_score IS NOT NULL")


def semantic_ranked(pages: DataFrame, documents: DataFrame, query: Sequence[float]) -> DataFrame:
    return global_row_number(kept(semantic_scores(pages, documents, query)), "semantic_score", "page_id", "semantic_rank")


#: The configurations that a translation can be in.
CONFIGS = ["simple", *dict.fromkeys(labels.FTS_CONFIGS.values())]


def indexed(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """pages with original_searchable and translated_searchable, the lexemes of both texts in order: what is written with a page whenever its texts change.

    The language is the document's, English if it has none; stop words leave empty strings, so that places stay. Null texts have no lexemes.
    """
    config = labels.fts_config(F.coalesce("target_language", F.lit("en")))
    found = pages.join(documents.select("document_id", "target_language"), "document_id", "left")
    return found.select(*(F.col(c) for c in pages.columns), text.tokens(F.col("original_markdown")).alias("original_searchable"), text.lexemes(text.tokens(F.col("translated_markdown")), config).alias("translated_searchable"))


def text_scores(pages: DataFrame, documents: DataFrame, query: str, analyzer: str | None = None) -> DataFrame:
    """(page_id, document_id, fts_score) of the searchable pages that match the query.

    Originals are always matched in the simple configuration, translations in the one of the document's language, or in `analyzer` if that is given.
    Scores of both add up.
    """
    found = searchable(pages, documents)
    simple = text.query_terms(query)
    config = F.lit(analyzer) if analyzer else labels.fts_config(F.coalesce("target_language", F.lit("en")))
    of = {c: terms for c in ([analyzer] if analyzer else CONFIGS) if (terms := text.query_terms(query, c))}
    if not simple:
        return found.select("page_id", "document_id", F.lit(0.0).alias("fts_score")).filter("false")
    ready = "original_searchable" in pages.columns and analyzer is None
    if ready:
        original = F.col("original_searchable")
        first = F.when(text.matches(original, simple), _density(original, simple))
    elif len(simple) == 1:
        # one term needs its number of occurrences alone
        hits = text.occurrences(F.col("original_markdown"), simple[0])
        first = F.when(_may_match(F.col("original_markdown"), simple) & (hits > 0), hits * F.lit(0.1))
    else:
        # a text that lacks a term's letters needs no tokens
        original = text.tokens(F.when(_may_match(F.col("original_markdown"), simple), F.col("original_markdown")))
        first = F.when(text.matches(original, simple), _density(original, simple))
    if ready:
        second = F.lit(None).cast("double")
        for c, terms in of.items():
            own = F.col("translated_searchable")
            second = F.when((config == c) & text.matches(own, terms), _density(own, terms)).otherwise(second)
    elif analyzer == "simple" and len(simple) == 1:
        hits = text.occurrences(F.col("translated_markdown"), simple[0])
        second = F.when(hits > 0, hits * F.lit(0.1))
    elif of:
        # only translations that may have all terms of their configuration leave the JVM
        may = F.lit(False)
        for c, terms in of.items():
            column = F.col("translated_markdown")
            may = F.when(config == c, _may_match(column, simple) if c == "simple" else text.may_have_stems(column, terms)).otherwise(may)
        second = text.language_scores(query, list(of))(F.when(may, text.tokens(F.col("translated_markdown"))), config)
    else:
        second = F.lit(None).cast("double")
    scored = found.select("page_id", "document_id", first.alias("_first"), second.alias("_second")).filter("_first IS NOT NULL OR _second IS NOT NULL")
    return scored.select("page_id", "document_id", F.round(F.coalesce("_first", F.lit(0.0)) + F.coalesce("_second", F.lit(0.0)), 9).alias("fts_score"))


def _may_match(column: Column, terms: list[str]) -> Column:
    low, hit = F.lower(column), F.lit(True)
    for t in terms:
        hit = hit & low.contains(t)
    return F.coalesce(hit, F.lit(False))


def _density(token_column: Column, terms: list[str]) -> Column:
    """Cover density; one term has a closed form."""
    if len(terms) == 1:
        return F.coalesce(text.frequency(token_column, terms[0]), F.lit(0)) * F.lit(0.1)
    return text.rank_texts(terms)(F.coalesce(token_column, F.array().cast("array<string>")))


def text_ranked(pages: DataFrame, documents: DataFrame, query: str, analyzer: str | None = None) -> DataFrame:
    return global_row_number(kept(text_scores(pages, documents, query, analyzer)), "fts_score", "page_id", "fts_rank")


FUSED = "semantic_score double, fts_score double, semantic_rank long, fts_rank long, rrf_score double"


def combined(pages: DataFrame, documents: DataFrame, query: str | None, vector: Sequence[float], k: int = RRF_K, analyzer: str | None = None, index=None) -> DataFrame:
    """Both lists joined in full by page, with the fused score; pages below the floor are gone.

    A page beyond a fixed rank in both lists cannot reach the floor, so only the best of each list matter, and the other list's rank of these is found by counting the rows before
    them: no list is sorted, exchanged or written to the shared folder. Matches, three values each, stay with the executors while they are read twice; the vectors are
    read twice. 2 * deepest(FLOOR, k) rows at most, 400 for k = 0, pass the driver, whatever the tables.
    """
    spark, most = pages.sparkSession, deepest(FLOOR, k)
    kind = "page_id {}, document_id {}, ".format(*(pages.schema[c].dataType.simpleString() for c in ("page_id", "document_id"))) + FUSED
    if not most:
        return spark.createDataFrame([], kind)
    near_all = semantic_scores(pages, documents, vector)
    near = best(near_all, "semantic_score", "page_id", most).collect()
    matches, points = None, []
    if query:
        matches = (text_scores(pages, documents, query, analyzer) if index is None else index.text_scores(pages, documents, query)).persist()
    matched = best(matches, "fts_score", "page_id", most).collect() if query else []
    text_score, text_rank = {r.page_id: r.fts_score for r in matched}, {r.page_id: n for n, r in enumerate(matched, 1)}
    if len(matched) == most:  # there may be more
        also = [r.page_id for r in near if r.page_id not in text_rank]
        points = [(r.fts_score, r.page_id) for r in matches.filter(F.col("page_id").isin(also)).collect()]
        text_score |= {i: s for s, i in points}
        text_rank |= ranks_by_counting(matches, "fts_score", "page_id", points)
    if matches is not None:
        matches.unpersist()
    vector_score, vector_rank = {r.page_id: r.semantic_score for r in near}, {r.page_id: n for n, r in enumerate(near, 1)}
    also = [r.page_id for r in matched if r.page_id not in vector_rank]
    if also and len(near) == most:
        points = [(r.semantic_score, r.page_id) for r in semantic_scores(pages.filter(F.col("page_id").isin(also)), documents, vector).collect()]
        vector_score |= {i: s for s, i in points}
        vector_rank |= ranks_by_counting(near_all, "semantic_score", "page_id", points)
    share = lambda rank: 1.0 / (float(k) + rank) if rank else 0.0
    rows = []
    for i, document in {r.page_id: r.document_id for r in [*near, *matched]}.items():
        score = share(vector_rank.get(i)) + share(text_rank.get(i))
        if score >= FLOOR:
            rows.append((i, document, vector_score.get(i, 0.0), text_score.get(i, 0.0), vector_rank.get(i), text_rank.get(i), score))
    return spark.createDataFrame(rows, kind)


def snippet(original: Column, translated: Column) -> Column:
    chosen = F.coalesce(translated, original)
    return F.when(F.length(chosen) > SNIPPET, F.concat(F.substring(chosen, 1, SNIPPET), F.lit("..."))).otherwise(chosen)


def hybrid_search(pages: DataFrame, documents: DataFrame, query: str | None, vector: Sequence[float], limit: int = PAGE_SIZE, offset: int = 0, k: int = RRF_K, analyzer: str | None = None, highlight: bool = True, index=None) -> DataFrame:
    """page_id, document_id, document_title, page_number, image_path, score, snippet: one page of results, best first. An empty query finds nothing.

    The ranking leaves few rows (`combined`), so their texts and numbers are read by key and no other text is touched. Headlines mark a translation in
    its language's configuration, an original in the simple one.
    """
    top = combined(pages, documents, query, vector, k, analyzer, index).orderBy(F.desc("rrf_score"), "page_id").offset(offset).limit(limit)
    ids = [r.page_id for r in top.select("page_id").collect()] if query else []
    chosen = pages.filter(F.col("page_id").isin(*ids)) if ids else pages.filter("false")
    shown = (
        F.broadcast(top)
        .join(chosen.select("page_id", "page_number", "image_path"), "page_id")
        .join(chosen.select("page_id", "original_markdown", "translated_markdown"), "page_id")
        .join(documents.select("document_id", "title", "target_language"), "document_id")
    )
    plain = snippet(F.col("original_markdown"), F.col("translated_markdown"))
    if highlight and query:
        translated = F.col("translated_markdown").isNotNull()
        config = F.when(translated, F.lit(analyzer) if analyzer else labels.fts_config(F.coalesce("target_language", F.lit("en")))).otherwise("simple")
        marked = text.language_headlines(query, list(dict.fromkeys([*CONFIGS, analyzer or "simple"])))(F.coalesce("translated_markdown", "original_markdown"), config)
        plain = F.when(F.col("fts_score") > 0, marked).otherwise(plain)
    return shown.select("page_id", "document_id", F.col("title").alias("document_title"), "page_number", "image_path", F.col("rrf_score").alias("score"), sanitizing.snippet_text(plain).alias("snippet")).orderBy(F.desc("score"), "page_id")


def hybrid_count(pages: DataFrame, documents: DataFrame, query: str | None, vector: Sequence[float], k: int = RRF_K, analyzer: str | None = None, index=None) -> DataFrame:
    """total: how many results there are."""
    found = combined(pages, documents, query, vector, k, analyzer, index)
    return (found if query else found.filter("false")).agg(F.count("*").alias("total"))


def document_search(pages: DataFrame, document_id: str, vector: Sequence[float], limit: int = CONTEXT_PAGES, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """The pages of one document most similar to the query, down to a floor; the document's own status does not matter."""
    similarity = vectors.cosine(F.col("embedding"), vector)
    found = pages.filter((F.col("document_id") == document_id) & (F.col("extraction_status") == "completed") & F.col("embedding").isNotNull())
    return found.withColumn("similarity", similarity).filter(F.col("similarity") >= min_similarity).select("page_id", "page_number", "original_markdown", "translated_markdown", "similarity").orderBy(F.desc("similarity"), "page_id").limit(limit)


def postings(pages: DataFrame, column: str = "original_markdown") -> DataFrame:
    """(lexeme, page_id, positions, tf): the materialised inverted index of a text column."""
    words = pages.select("page_id", F.posexplode(text.tokens(F.col(column))).alias("at", "lexeme"))
    return words.groupBy("lexeme", "page_id").agg(F.array_sort(F.collect_list("at")).alias("positions"), F.count("*").alias("tf"))


def match_postings(index: DataFrame, terms: list[str]) -> DataFrame:
    """(page_id, tf) of the pages that hold all terms, by way of the index."""
    found = index.filter(F.col("lexeme").isin(*terms)).groupBy("page_id").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"))
    return found.filter(F.col("n") == len(set(terms))).select("page_id", "tf")
