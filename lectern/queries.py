"""The inventory: one query for each operator over the driver's tables, and the DuckDB text of the same result where SQL expresses it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import schema
from . import workload as w
from .functions import labels, sanitizing, text, vectors
from .operators import corpus, lifecycle, ops, search, store, text_index, vector_index
from .plans import keep
from .sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

C = F.col
DOC = "src1-en"
QUERY_VECTOR = 7
WORD, WORDS = "nicht", "the and"

#: A question of several words; in German the first one is a stop word and the others have stems, in the other languages of the tables no text has all of them.
ASKED = "die heiten ung"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def vector(spark: SparkSession, sf_dir: str, vec_id: int = QUERY_VECTOR) -> list[float]:
    """The query vector that stands in for an embedding model: one row by its key."""
    return list(w.table(spark, sf_dir, "embeddings").filter(C("vec_id") == vec_id).first().embedding)


# A stand-in for a model that embeds: the length of a text. Vectors hold floats, which are exact up to 2**24, so it takes two of them. Lambdas travel by value; workers need not load this module.
length_vector = lambda t: [len(t) >> 24, len(t) & 0xFFFFFF]


def length_of(vector: Column) -> Column:
    """The length that such a vector holds; null without a vector."""
    return vector[0].cast("long") * (1 << 24) + vector[1].cast("long")


def on_pages(name: str, build: Callable[[DataFrame], DataFrame], sql: str):
    query(name, w.ONLY_PAGES + sql)(lambda s, d: build(w.pages(s, d)))


def on_documents(name: str, build: Callable[[DataFrame], DataFrame], sql: str):
    query(name, w.ONLY_DOCUMENTS + sql)(lambda s, d: build(w.documents(s, d)))


def on_both(name: str, build: Callable[[DataFrame, DataFrame], DataFrame], sql: str):
    query(name, w.BOTH + sql)(lambda s, d: build(w.documents(s, d), w.pages(s, d)))


def on_inputs(name: str, build: Callable[[DataFrame], DataFrame], sql: str):
    query(name, w.ONLY_INPUTS + sql)(lambda s, d: build(w.inputs(s, d)))


def on_table(name: str, table: str, build: Callable[[DataFrame], DataFrame], sql: str | None):
    query(name, sql)(lambda s, d: build(w.table(s, d, table)))


def by_id(name: str, column, sql: str, key: str = "id"):
    """A scalar rule over the validator inputs."""
    on_inputs(name, lambda i: i.select(key, column().alias("out")), f"SELECT {key}, {sql} AS out FROM w_inputs")


# --- scans, lookups and sinks -------------------------------------------------------------------------------------------

DOC_COLUMNS = "document_id, title, original_filename, total_pages, status, target_language, error_message, inserted_at"
PAGE_COLUMNS = "page_id, document_id, page_number, image_path, extraction_status, translation_status, embedding_status"
_pc = PAGE_COLUMNS.split(", ")

on_documents("scan_documents", lambda d: corpus.scan_documents(d), f"SELECT {DOC_COLUMNS} FROM w_documents ORDER BY inserted_at DESC, document_id")
on_documents("sort_documents", lambda d: corpus.scan_documents(d, "title", "asc"), f"SELECT {DOC_COLUMNS} FROM w_documents ORDER BY title, document_id")
on_pages("scan_pages_by_doc", lambda p: corpus.pages_of(p, DOC).select(*_pc), f"SELECT {PAGE_COLUMNS} FROM w_pages WHERE document_id = '{DOC}' ORDER BY page_number")
on_documents("point_lookup_id", lambda d: corpus.point(d, document_id=DOC), f"SELECT {DOC_COLUMNS} FROM w_documents WHERE document_id = '{DOC}'")
on_pages("point_lookup_composite", lambda p: corpus.point(p, document_id=DOC, page_number=2).select(*_pc), f"SELECT {PAGE_COLUMNS} FROM w_pages WHERE document_id = '{DOC}' AND page_number = 2")
query("db_ping", "SELECT 1 AS ok")(lambda s, d: s.sql("SELECT 1 AS ok"))


@query("sql_scan_raw", w.ONLY_PAGES + "SELECT document_id, count(*) AS n FROM w_pages WHERE extraction_status = 'completed' AND page_number >= 3 GROUP BY document_id")
def _(s, d):
    return s.sql("SELECT document_id, count(*) AS n FROM {p} WHERE extraction_status = :status AND page_number >= :least GROUP BY document_id", args={"status": "completed", "least": 3}, p=w.pages(s, d))


on_inputs("format_router", lambda i: i.select("id", labels.format_route(C("filename")).alias("out")), r"SELECT id, CASE lower(regexp_extract(filename, '\.[^./]*$')) WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'convertible' WHEN '.doc' THEN 'convertible' WHEN '.odt' THEN 'convertible' WHEN '.rtf' THEN 'convertible' ELSE 'unsupported' END AS out FROM w_inputs")
on_table("image_list_sort", "documents", lambda t: files.images(t.selectExpr("doc_id", "'pages/page-' || lpad(doc_id, 5, '0') || CASE WHEN doc_id % 3 = 0 THEN '.jpg' ELSE '.png' END AS path")).select("doc_id", "path", "page_number"), r"SELECT doc_id, path, regexp_extract(path, 'page-0*(\d+)\.png$', 1)::INT AS page_number FROM (SELECT doc_id, 'pages/page-' || lpad(doc_id::VARCHAR, 5, '0') || CASE WHEN doc_id % 3 = 0 THEN '.jpg' ELSE '.png' END AS path FROM documents) WHERE path LIKE '%.png' ORDER BY page_number")
on_table("pdf_page_count", "documents", lambda t: t.select("doc_id", files.page_count(F.expr("'Title: x' || chr(10) || CASE WHEN doc_id % 4 = 0 THEN 'none' ELSE 'Pages:   ' || n_chars END")).alias("n")), "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN n_chars::INT END AS n FROM documents")
on_table("image_base64_source", "documents", lambda t: t.select("doc_id", F.regexp_replace(F.base64(C("text").cast("binary")), r"\s", "").alias("image")), "SELECT doc_id, to_base64(encode(text)) AS image FROM documents")

NEW_DOC = "SELECT 'new' AS document_id, 'New title' AS title, 'new.pdf' AS original_filename, 3 AS total_pages, 'uploading' AS status, 'en' AS target_language, CAST(NULL AS VARCHAR(9)) AS error_message, TIMESTAMP '2024-06-01 00:00:00' AS inserted_at"


@query("sink_insert", w.ONLY_DOCUMENTS + f"SELECT {DOC_COLUMNS} FROM w_documents UNION ALL {NEW_DOC}")
def _(s, d):
    new = s.sql(NEW_DOC.replace("TIMESTAMP '", "TIMESTAMP_NTZ '").replace("3 AS", "3L AS"))
    return corpus.inserted(w.documents(s, d), new)


@query("sink_bulk_insert", w.ONLY_PAGES + f"SELECT {PAGE_COLUMNS} FROM w_pages UNION ALL SELECT 1000000 + i - 1, 'new', i, 'page_' || i, 'pending', 'pending', 'pending' FROM (SELECT unnest(range(1, 6))::INT AS i)")
def _(s, d):
    images = s.range(1, 6).selectExpr("cast(id AS int) AS page_number", "'page_' || id AS image_path")
    return corpus.bulk_pages(w.pages(s, d), "new", images, 1_000_000).select(*_pc)


on_both(
    "sink_update",
    # the error message is set to null, and each change comes twice
    lambda d, p: corpus.updated(d, (lambda x: x.unionByName(x))(d.filter("status IN ('processing', 'error')").select("document_id", F.lit("completed").alias("status"), F.concat("title", F.lit(" (done)")).alias("title"), F.lit(None).cast("string").alias("error_message"))), "document_id").select("document_id", "title", "status", "error_message"),
    "SELECT document_id, title || CASE WHEN status IN ('processing', 'error') THEN ' (done)' ELSE '' END AS title, CASE WHEN status IN ('processing', 'error') THEN 'completed' ELSE status END AS status, CASE WHEN status NOT IN ('processing', 'error') THEN error_message END AS error_message FROM w_documents",
)
FTS_CASE = "CASE target_language WHEN 'da' THEN 'danish' WHEN 'de' THEN 'german' WHEN 'en' THEN 'english' WHEN 'es' THEN 'spanish' WHEN 'fr' THEN 'french' WHEN 'it' THEN 'italian' WHEN 'nl' THEN 'dutch' WHEN 'no' THEN 'norwegian' WHEN 'pt' THEN 'portuguese' WHEN 'sv' THEN 'swedish' ELSE 'simple' END"
on_both("sink_update_from_join", lambda d, p: corpus.backfilled(p, d).select("page_id", "fts_config"), f"SELECT page_id, {FTS_CASE} AS fts_config FROM w_pages LEFT JOIN w_documents USING (document_id)")
on_both("trigger_lookup", lambda d, p: p.select("page_id", "document_id").join(d.select("document_id", "target_language"), "document_id", "left").select("page_id", "target_language"), "SELECT page_id, target_language FROM w_pages LEFT JOIN w_documents USING (document_id)")
on_both("sink_delete_cascade", lambda d, p: corpus.deleted(d, p, d.filter("status = 'error'").select("document_id"))[1].groupBy("document_id").count().select("document_id", C("count").alias("n")), "SELECT document_id, count(*) AS n FROM w_pages WHERE document_id NOT IN (SELECT document_id FROM w_documents WHERE status = 'error') GROUP BY document_id")
on_pages(
    "sink_reset_row",
    lambda p: corpus.reset_rows(p, C("page_id") % 3 == 0).select("page_id", C("original_markdown").isNull().alias("no_text"), C("embedding").isNull().alias("no_vector"), "extraction_status", "translation_status", "embedding_status"),
    "SELECT page_id, page_id % 3 = 0 OR original_markdown IS NULL AS no_text, page_id % 3 = 0 OR embedding IS NULL AS no_vector, CASE page_id % 3 WHEN 0 THEN 'pending' ELSE extraction_status END AS extraction_status, CASE page_id % 3 WHEN 0 THEN 'pending' ELSE translation_status END AS translation_status, CASE page_id % 3 WHEN 0 THEN 'pending' ELSE embedding_status END AS embedding_status FROM w_pages",
)
on_pages(
    "page_retry_reset",
    lambda p: corpus.retried(p, C("extraction_status") == "error").select("page_id", "extraction_status", "translation_status", F.length("original_markdown").cast("long").alias("n")),
    "SELECT page_id, CASE extraction_status WHEN 'error' THEN 'pending' ELSE extraction_status END AS extraction_status, CASE extraction_status WHEN 'error' THEN 'pending' ELSE translation_status END AS translation_status, length(original_markdown) AS n FROM w_pages",
)
on_pages("page_error_mark", lambda p: corpus.marked_failed(p, C("extraction_status") == "processing").select("page_id", "extraction_status"), "SELECT page_id, CASE extraction_status WHEN 'processing' THEN 'error' ELSE extraction_status END AS extraction_status FROM w_pages")
on_pages("page_status_get", lambda p: corpus.point(p, page_id=20).select("page_id", "extraction_status"), "SELECT page_id, extraction_status FROM w_pages WHERE page_id = 20")
on_documents("doc_status_get", lambda d: corpus.point(d, document_id="src3-en").select("document_id", "status"), "SELECT document_id, status FROM w_documents WHERE document_id = 'src3-en'")


@query("page_status_update", w.ONLY_PAGES + "SELECT page_id, CASE WHEN page_id % 10 = 1 THEN 'completed' ELSE extraction_status END AS extraction_status FROM w_pages")
def _(s, d):
    p = w.pages(s, d)
    changes = p.filter("page_id % 10 = 1").select("page_id", F.lit("completed").alias("extraction_status")).unionByName(s.sql("SELECT -5L AS page_id, 'error' AS extraction_status"))
    return corpus.updated(p.select("page_id", "extraction_status"), changes, "page_id")


# --- filters and predicates ---------------------------------------------------------------------------------------------

on_pages("proj_named_row", lambda p: p.select("page_id", "document_id", "page_number", "image_path"), "SELECT page_id, document_id, page_number, image_path FROM w_pages")
_active = f"SELECT {DOC_COLUMNS} FROM w_documents WHERE status IN ('processing', 'queued') ORDER BY inserted_at, document_id"
on_documents("filter_status_in", corpus.in_progress, _active)
on_documents("recover_list", corpus.in_progress, _active)
on_both("filter_searchable_page", lambda d, p: search.searchable(p.filter("embedding IS NOT NULL"), d).select("page_id", "document_id"), "SELECT page_id, document_id FROM w_pages JOIN w_documents d USING (document_id) WHERE d.status = 'completed' AND extraction_status = 'completed' AND embedding IS NOT NULL")

TOK = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
TF = "len(list_filter(" + TOK + ", lambda t: t = '{1}'))"
_o, _t = TF.format("original_markdown", WORD), TF.format("translated_markdown", WORD)
# the word is a German stop word; no other word of the tables has it as its stem in another language
FTS_SQL = f"fts AS (SELECT page_id, document_id, ({_o} * 0.1::DOUBLE + CASE target_language WHEN 'de' THEN 0 ELSE {_t} END * 0.1::DOUBLE) AS fts_score FROM w_pages JOIN w_documents d USING (document_id) WHERE d.status = 'completed' AND extraction_status = 'completed' AND ({_o} > 0 OR CASE target_language WHEN 'de' THEN 0 ELSE {_t} END > 0))"

# The words of the tables that the published German stemmer reduces to two stems.
STEMS = {
    "heit": "heit heiten heitst heiter heitener heitenlich heitsten heitenen heiterer heitenheit heiterheit heiteren heitster heiterlich",
    "ung": "ung unger ungen ungerlich ungeren ungenen ungerer ungenheit ungerheit ungenlich ungener",
}
STEMS_SQL = "stems AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{stem}')" for stem, words in STEMS.items() for w in words.split()) + ") t(word, stem))"


def COVER_SQL(name: str, pages: str, column: str, stems: str, n_terms: int) -> str:
    """Cover density by definition: among the places of the terms (word, stem), each shortest run that has all of them counts 0.1 / (1 + other words in it)."""
    return f"""{name}_e AS (SELECT page_id, pos, stem FROM (SELECT page_id, unnest(toks) AS word, unnest(range(len(toks))) AS pos FROM (SELECT page_id, {TOK.format(column)} AS toks FROM {pages})) JOIN {stems} USING (word)),
{name}_r AS (SELECT e.page_id, e.pos, min(x.pos) AS start FROM {name}_e e, LATERAL (SELECT stem, max(pos) AS pos FROM {name}_e l WHERE l.page_id = e.page_id AND l.pos <= e.pos GROUP BY stem) x GROUP BY ALL HAVING count(*) = {n_terms}),
{name}_c AS (SELECT page_id, start, min(pos) AS stop FROM {name}_r GROUP BY ALL),
{name} AS (SELECT page_id, sum(0.1::DOUBLE / (1 + (stop - start + 1) - (SELECT count(*) FROM {name}_e e WHERE e.page_id = c.page_id AND e.pos BETWEEN start AND stop))) AS score FROM {name}_c c GROUP BY 1)"""


_own = "(SELECT p.* FROM w_pages p JOIN w_documents d USING (document_id) WHERE d.status = 'completed' AND extraction_status = 'completed'{})"
ASKED_TERMS = "plain AS (SELECT word, word AS stem FROM (VALUES " + ", ".join(f"('{x}')" for x in ASKED.split()) + ") t(word))"
#: What the question finds: originals by its words, German translations by the two stems.
ASKED_SQL = (
    f"{STEMS_SQL}, {ASKED_TERMS}, " + COVER_SQL("inn", _own.format(""), "original_markdown", "plain", 3) + ", " + COVER_SQL("outt", _own.format(" AND target_language = 'de'"), "translated_markdown", "stems", 2)
    + ", fts AS (SELECT page_id, document_id, round(coalesce(inn.score, 0) + coalesce(outt.score, 0), 9) AS fts_score FROM w_pages LEFT JOIN inn USING (page_id) LEFT JOIN outt USING (page_id) WHERE inn.score > 0 OR outt.score > 0)"
)


def SEM_SQL(vec: int = QUERY_VECTOR) -> str:
    return f"sem AS (SELECT page_id, document_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {vec})), 9) AS semantic_score FROM w_pages JOIN w_documents d USING (document_id) WHERE d.status = 'completed' AND extraction_status = 'completed' AND embedding IS NOT NULL)"


def FUSED_SQL(k: int = 60, fts: str = FTS_SQL) -> str:
    return (
        w.BOTH
        + f""", {fts}, {SEM_SQL()},
fr AS (SELECT *, row_number() OVER (ORDER BY fts_score DESC, page_id) AS fts_rank FROM fts), sr AS (SELECT *, row_number() OVER (ORDER BY semantic_score DESC, page_id) AS semantic_rank FROM sem),
rrf AS (SELECT coalesce(sr.page_id, fr.page_id) AS page_id, coalesce(sr.document_id, fr.document_id) AS document_id, coalesce(fts_score, 0) AS fts_score, coalesce(semantic_score, 0) AS semantic_score, semantic_rank, fts_rank,
  coalesce(1.0::DOUBLE / ({k}::DOUBLE + semantic_rank), 0) + coalesce(1.0::DOUBLE / ({k}::DOUBLE + fts_rank), 0) AS rrf_score FROM sr FULL OUTER JOIN fr ON sr.page_id = fr.page_id) """
    )


def docs_pages(s, d):
    return w.documents(s, d), w.pages(s, d)


@query("filter_fts_match", w.BOTH + f", {FTS_SQL} SELECT page_id, document_id, round(fts_score, 6) AS fts_score FROM fts")
def _(s, d):
    doc, p = docs_pages(s, d)
    return search.text_scores(p, doc, WORD).withColumn("fts_score", F.round("fts_score", 6))


@query("fts_rank", w.BOTH + f", {FTS_SQL} SELECT page_id, row_number() OVER (ORDER BY fts_score DESC, page_id) AS fts_rank FROM fts")
def _(s, d):
    doc, p = docs_pages(s, d)
    return search.text_ranked(p, doc, WORD).select("page_id", "fts_rank")


@query("semantic_rank", w.BOTH + f", {SEM_SQL()} SELECT page_id, semantic_score, row_number() OVER (ORDER BY semantic_score DESC, page_id) AS semantic_rank FROM sem")
def _(s, d):
    doc, p = docs_pages(s, d)
    return search.semantic_ranked(p, doc, vector(s, d)).select("page_id", "semantic_score", "semantic_rank")


@query("cosine_similarity", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {QUERY_VECTOR})), 9) AS similarity FROM embeddings")
def _(s, d):
    return w.table(s, d, "embeddings").select("vec_id", vectors.cosine(C("embedding"), vector(s, d)).alias("similarity"))


@query("query_vector_cross", ORACLES["cosine_similarity"])
def _(s, d):
    """The same by matrix products over Arrow batches; the query is a literal, so there is no join."""
    return w.table(s, d, "embeddings").select("vec_id", vectors.cosine_batches(vector(s, d))("embedding").alias("similarity"))


@query("filter_similarity_floor", f"SELECT * FROM ({ORACLES['cosine_similarity']}) WHERE similarity >= 0.2")
def _(s, d):
    return QUERIES["cosine_similarity"](s, d).filter("similarity >= 0.2")


@query("topk_similarity", f"SELECT * FROM ({ORACLES['cosine_similarity']}) ORDER BY similarity DESC, vec_id LIMIT 3")
def _(s, d):
    return QUERIES["cosine_similarity"](s, d).orderBy(F.desc("similarity"), "vec_id").limit(3)


@query("topk_similarity_indexed", ORACLES["topk_similarity"])
def _(s, d):
    """The same from stored centroid lists, by the exact search; a part of the vectors comes by a later batch."""
    v = w.table(s, d, "embeddings").select("vec_id", C("embedding").alias("vector"))
    index = vector_index.VectorIndex(stored(s, "vectors"), "vec_id")
    index.create(v.withColumn("vector", F.when(C("vec_id") % 20 == 1, F.transform("vector", lambda x: -x)).otherwise(C("vector"))))
    index.write(v.filter("vec_id % 20 = 1"), 1)
    return index.search(s, vector(s, d), 3, exact=True)


@query("rrf_score", FUSED_SQL() + "SELECT page_id, semantic_rank, fts_rank, rrf_score FROM rrf WHERE rrf_score >= 0.01")
def _(s, d):
    doc, p = docs_pages(s, d)
    return search.combined(p, doc, WORD, vector(s, d)).select("page_id", "semantic_rank", "fts_rank", "rrf_score")


@query("join_rrf_full_outer", FUSED_SQL(100) + "SELECT page_id, document_id, semantic_rank, fts_rank, rrf_score FROM rrf WHERE rrf_score >= 0.01")
def _(s, d):
    doc, p = docs_pages(s, d)
    return search.combined(p, doc, WORD, vector(s, d), 100).select("page_id", "document_id", "semantic_rank", "fts_rank", "rrf_score")


@query("filter_rrf_floor", FUSED_SQL(30) + "SELECT page_id, rrf_score FROM rrf WHERE rrf_score >= 0.01")
def _(s, d):
    doc, p = docs_pages(s, d)
    return search.combined(p, doc, WORD, vector(s, d), 30).select("page_id", "rrf_score")


@query("topk_rrf_page", FUSED_SQL() + "SELECT page_id, rrf_score FROM rrf WHERE rrf_score >= 0.01 ORDER BY rrf_score DESC, page_id LIMIT 20 OFFSET 20")
def _(s, d):
    doc, p = docs_pages(s, d)
    return search.combined(p, doc, WORD, vector(s, d)).select("page_id", "rrf_score").orderBy(F.desc("rrf_score"), "page_id").offset(20).limit(20)


SNIP = "CASE WHEN length(coalesce(translated_markdown, original_markdown)) > 200 THEN left(coalesce(translated_markdown, original_markdown), 200) || '...' ELSE coalesce(translated_markdown, original_markdown) END"
CLEAN = r"trim(regexp_replace(regexp_replace({}, '</?b>', '', 'g'), '\s+', ' ', 'g'))"


@query(
    "hybrid_search",
    FUSED_SQL() + f"SELECT r.page_id, r.document_id, d.title AS document_title, p.page_number, p.image_path, r.rrf_score AS score, {CLEAN.format(SNIP)} AS snippet FROM (SELECT * FROM rrf WHERE rrf_score >= 0.01 ORDER BY rrf_score DESC, page_id LIMIT 20) r JOIN w_pages p USING (page_id) JOIN w_documents d ON d.document_id = r.document_id ORDER BY score DESC, r.page_id",
)
def _(s, d):
    doc, p = docs_pages(s, d)
    return search.hybrid_search(p, doc, WORD, vector(s, d), highlight=False)


@query("join_hydrate", FUSED_SQL() + "SELECT r.page_id, d.title, p.page_number FROM (SELECT * FROM rrf WHERE rrf_score >= 0.01 ORDER BY rrf_score DESC, page_id LIMIT 20 OFFSET 5) r JOIN w_pages p USING (page_id) JOIN w_documents d ON d.document_id = r.document_id")
def _(s, d):
    doc, p = docs_pages(s, d)
    return search.hybrid_search(p, doc, WORD, vector(s, d), offset=5, highlight=False).select("page_id", C("document_title").alias("title"), "page_number")


HEADS = r"""CASE WHEN n_hits = 0 THEN array_to_string(words[1:15], ' ') ELSE array_to_string(list_transform(range(start + 1, least(start + 35, len(words)) + 1), lambda k: CASE WHEN hit[k] THEN '<b>' || words[k] || '</b>' ELSE words[k] END), ' ') END"""


def HEADLINE_SQL(rows: str, text_column: str, marked: str) -> str:
    """rows with headline: 35 words from 10 before the first word that has one of the marked ones, all such words marked; without any the first 15."""
    words = rf"list_filter(string_split_regex({text_column}, '\s+'), lambda x: x <> '')"
    hit = rf"list_transform(words, lambda x: len(list_intersect(string_split_regex(lower(x), '[^\p{{L}}\p{{N}}]+'), {marked})) > 0)"
    start = "greatest(0, least(list_position(hit, true) - 11, len(words) - 35))"
    return f"(SELECT *, {HEADS} AS headline FROM (SELECT *, len(list_filter(hit, lambda x: x)) AS n_hits, {start} AS start FROM (SELECT *, {hit} AS hit FROM (SELECT *, {words} AS words FROM ({rows})))))"


_top = "SELECT r.page_id, r.document_id, d.title AS document_title, d.target_language, p.page_number, p.image_path, r.rrf_score AS score, r.fts_score, p.translated_markdown, p.original_markdown FROM (SELECT * FROM rrf WHERE rrf_score >= 0.01 ORDER BY rrf_score DESC, page_id LIMIT 20) r JOIN w_pages p USING (page_id) JOIN w_documents d ON d.document_id = r.document_id"
# in a translation the words of the stems are marked, in an original the question's own
_marked = "CASE WHEN translated_markdown IS NULL OR target_language <> 'de' THEN {} ELSE {} END"


def TOP_SQL(fts: str, plain: str, german: str) -> str:
    rows = HEADLINE_SQL(_top, "coalesce(translated_markdown, original_markdown)", _marked.format(plain, german))
    return FUSED_SQL(fts=fts) + f"SELECT page_id, document_id, document_title, page_number, image_path, score, {CLEAN.format(f'CASE WHEN fts_score > 0 THEN headline ELSE {SNIP} END')} AS snippet FROM {rows} ORDER BY score DESC, page_id"


@query("hybrid_search_highlighted", TOP_SQL(FTS_SQL, f"['{WORD}']", "[]::VARCHAR[]"))
def _(s, d):
    doc, p = docs_pages(s, d)
    return search.hybrid_search(p, doc, WORD, vector(s, d))


@query("hybrid_search_languages", TOP_SQL(ASKED_SQL, str(ASKED.split()), str([w for words in STEMS.values() for w in words.split()])))
def _(s, d):
    """Several words; translations matched and marked in their language's configuration: stop words and stems."""
    doc, p = docs_pages(s, d)
    return search.hybrid_search(p, doc, ASKED, vector(s, d))


@query("fts_match_languages", w.BOTH + f", {ASKED_SQL} SELECT page_id, document_id, fts_score FROM fts")
def _(s, d):
    """The text list alone, for several words."""
    doc, p = docs_pages(s, d)
    return search.text_scores(p, doc, ASKED)


@query("fts_match_indexed", ORACLES["fts_match_languages"])
def _(s, d):
    """The same from the derived columns that are written with each page."""
    doc, p = docs_pages(s, d)
    return search.text_scores(search.indexed(p, doc), doc, ASKED)


def stored(s, name: str) -> str:
    """A new folder for what a query stores, beside the session's checkpoints."""
    return f"{keep.shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def older(p: DataFrame) -> DataFrame:
    """The pages as they were before their last writes: some had other texts, some were not there, and some are gone since."""
    was = lambda c: F.when(C("page_id") % 50 == 3, F.lit("die heiten ung, as it was")).otherwise(C(c)).alias(c)
    before = p.filter("page_id % 50 <> 4").select(*(was(c) if c in ("original_markdown", "translated_markdown") else c for c in p.columns))
    return before.unionByName(p.filter("page_id % 50 = 5").withColumn("page_id", -1 - C("page_id")))


@query("fts_match_stored", ORACLES["fts_match_languages"])
def _(s, d):
    """The same from posting lists that are stored in buckets of lexemes: built from the older texts, then brought up to date by two batches."""
    doc, p = docs_pages(s, d)
    index = text_index.TextIndex(stored(s, "postings"))
    index.write(older(p), doc, 0)
    index.write(p.filter("page_id % 50 IN (3, 4)"), doc, 1)
    index.write(p.filter("false"), doc, 2, removed=p.filter("page_id % 50 = 5").select((-1 - C("page_id")).alias("page_id")))
    return index.text_scores(p, doc, ASKED)


# By language the words of the tables that its published stemmer reduces to the stem of the question.
LIKE = {
    "da": "oning oningen oninger oningeren oningerer oninges",
    "de": "oning oningen oningenen oninger oningeren oningerer oninges oningst oningstes",
    "en": "oned onedly ones oning oningly",
    "es": "oning oningan oninged oningen oninger oninges",
    "fr": "oning oningea oninger oninges",
    "it": "oning oningha oninghe",
    "nl": "oning oningen oninging",
    "no": "oning oningen oninger oninges",
    "pt": "oning oningea oninger oninges oningou",
    "sv": "oning oningat oningen oninger oninges oningor",
}
TEN = "oning"
LIKE_SQL = "likes AS (SELECT * FROM (VALUES " + ", ".join(f"('{lang}', {words.split()})" for lang, words in LIKE.items()) + ") t(lang, words))"
_ten = "[" + ", ".join(f"'{x}'" for x in LIKE) + "][1 + regexp_extract(document_id, 'src([0-9]+)', 1)::INT % 10]"


@query(
    "fts_match_configurations",
    w.BOTH + f""", {LIKE_SQL} SELECT page_id, document_id, round((o + t) * 0.1::DOUBLE, 9) AS fts_score FROM (
  SELECT page_id, document_id, {TF.format('original_markdown', TEN)} AS o, CASE WHEN translated_markdown IS NULL THEN 0 ELSE len(list_filter({TOK.format('translated_markdown')}, lambda x: list_contains(words, x))) END AS t
  FROM (SELECT p.*, words FROM w_pages p JOIN w_documents d USING (document_id) JOIN likes ON lang = {_ten.replace('document_id', 'd.document_id')} WHERE d.status = 'completed' AND extraction_status = 'completed')) WHERE o + t > 0""",
)
def _(s, d):
    """Documents of ten languages, each analysed in its own configuration, from stored posting lists: stems of one question in all of them, without Python when it is asked."""
    doc, p = docs_pages(s, d)
    number = F.regexp_extract("document_id", "src([0-9]+)", 1).cast("int") % 10
    doc = doc.withColumn("target_language", F.element_at(F.array(*map(F.lit, LIKE)), number + 1))
    index = text_index.TextIndex(stored(s, "postings"))
    index.write(p, doc, 0)
    return index.text_scores(p, doc, TEN)


@query("hybrid_search_stored", ORACLES["hybrid_search_languages"])
def _(s, d):
    """Both lists fused, the text list from stored postings."""
    doc, p = docs_pages(s, d)
    index = text_index.TextIndex(stored(s, "postings"))
    index.write(p, doc, 0)
    return search.hybrid_search(p, doc, ASKED, vector(s, d), index=index)


@query("sink_stored_writes", w.ONLY_PAGES + "SELECT page_id, document_id, extraction_status, translation_status, length(original_markdown) AS n FROM w_pages")
def _(s, d):
    """A stored table of pages after an upsert that changes and adds, the same one again, and a deletion."""
    p = w.pages(s, d).select("page_id", "document_id", "extraction_status", "translation_status", "original_markdown")
    table = store.Table(stored(s, "pages"), "page_id", "document_id", 16)
    table.create(older(p.withColumn("translated_markdown", F.lit(None).cast("string"))).drop("translated_markdown"))
    for _ in range(2):
        table.upsert(p.filter("page_id % 50 IN (3, 4)"), 1)
    table.delete(p.filter("page_id % 50 = 5").select((-1 - C("page_id")).alias("page_id"), "document_id"), 2)
    return table.read(s).select("page_id", "document_id", "extraction_status", "translation_status", F.length("original_markdown").cast("long").alias("n"))


# pages and documents as they were if constraints did not hold
_BROKEN_PAGES = """SELECT page_id, CASE WHEN page_id % 60 = 2 THEN 'gone' ELSE document_id END AS document_id, CASE WHEN page_id % 40 = 1 THEN 1 ELSE page_number END AS page_number, CASE WHEN page_id % 70 = 4 THEN 'odd' WHEN page_id % 70 = 5 THEN NULL ELSE extraction_status END AS extraction_status,
translation_status, embedding_status, CASE WHEN page_id % 30 = 3 THEN {half} ELSE embedding END AS embedding FROM {pages}"""
_BROKEN_DOCUMENTS = "SELECT CASE WHEN document_id IN ('src0-en', 'src0-de') THEN 'src0' ELSE document_id END AS id, CASE WHEN document_id = 'src2-en' THEN 'lost' ELSE status END AS status FROM {documents}"


@query(
    "constraint_violations",
    w.BOTH + f""", p AS ({_BROKEN_PAGES.format(half='embedding[1:10]', pages='w_pages')}), d AS ({_BROKEN_DOCUMENTS.format(documents='w_documents')}), r AS (
  SELECT 'status of documents' AS rule, count(*) AS n FROM d WHERE coalesce(status NOT IN ('uploading', 'queued', 'extracting', 'processing', 'completed', 'error'), true)
  UNION ALL SELECT 'extraction_status of pages', count(*) FROM p WHERE coalesce(extraction_status NOT IN ('pending', 'processing', 'completed', 'error'), true)
  UNION ALL SELECT 'documents.id is unique', count(*) FROM (SELECT id FROM d GROUP BY id HAVING count(*) > 1)
  UNION ALL SELECT 'one page of a number in a document', count(*) FROM (SELECT 1 FROM p GROUP BY document_id, page_number HAVING count(*) > 1)
  UNION ALL SELECT 'every page has a document', count(*) FROM p WHERE document_id NOT IN (SELECT id FROM d)
  UNION ALL SELECT 'length of embedding', count(*) FROM p WHERE len(embedding) <> 64) SELECT rule, n FROM r WHERE n > 0""",
)
def _(s, d):
    """What a store's constraints would refuse."""
    doc, p = docs_pages(s, d)
    return schema.violations(s.sql(_BROKEN_DOCUMENTS, documents=doc), s.sql(_BROKEN_PAGES.replace("{half}", "slice(embedding, 1, 10)"), pages=p), 64)


_count_languages = FUSED_SQL(fts=ASKED_SQL) + "SELECT count(*) AS total FROM rrf WHERE rrf_score >= 0.01"


@query("hybrid_count_languages", _count_languages)
def _(s, d):
    doc, p = docs_pages(s, d)
    return search.hybrid_count(p, doc, ASKED, vector(s, d))


@query(
    "searchable_columns",
    w.BOTH + f", {STEMS_SQL} SELECT page_id, len({TOK.format('original_markdown')})::BIGINT AS n_original, {TOK.format('original_markdown')}[1] AS first_word, CASE WHEN target_language = 'de' THEN (SELECT count(*) FROM (SELECT unnest({TOK.format('translated_markdown')}) AS word) JOIN stems USING (word)) END AS n_stems FROM w_pages JOIN w_documents USING (document_id)",
)
def _(s, d):
    """The lexemes that go with a page: numbers of an original's tokens and of the two stems in German translations."""
    doc, p = docs_pages(s, d)
    found = search.indexed(p, doc).join(doc.select("document_id", "target_language"), "document_id")
    stems = F.size(F.filter(F.coalesce("translated_searchable", F.array().cast("array<string>")), lambda x: x.isin(*STEMS)))
    return found.select("page_id", F.size("original_searchable").cast("long").alias("n_original"), F.try_element_at("original_searchable", F.lit(1)).alias("first_word"), F.when(C("target_language") == "de", stems.cast("long")).alias("n_stems"))


_count = FUSED_SQL() + "SELECT count(*) AS total FROM rrf WHERE rrf_score >= 0.01"


@query("hybrid_count", _count)
def _(s, d):
    doc, p = docs_pages(s, d)
    return search.hybrid_count(p, doc, WORD, vector(s, d))


query("count_results", _count)(QUERIES["hybrid_count"])
DOC_SEARCH = f"(SELECT page_id, page_number, original_markdown, translated_markdown, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {QUERY_VECTOR})), 9) AS similarity FROM w_pages WHERE document_id = '{{}}' AND extraction_status = 'completed' AND embedding IS NOT NULL)"


def own_document(s, d) -> str:
    """The document of the page whose vector is the query."""
    row = w.table(s, d, "documents").filter(C("doc_id") == QUERY_VECTOR).first()
    return f"{row.source}-{row.lang}"


OWN = f"(SELECT source || '-' || lang FROM documents WHERE doc_id = {QUERY_VECTOR})"


@query("document_search", w.ONLY_PAGES + f"SELECT * FROM {DOC_SEARCH.format('x').replace(chr(39) + 'x' + chr(39), OWN)} WHERE similarity >= -0.2 ORDER BY similarity DESC, page_id LIMIT 3")
def _(s, d):
    return search.document_search(w.pages(s, d), own_document(s, d), vector(s, d), 3, -0.2)


on_table("format_snippet", "pages", lambda t: t.select("page_id", sanitizing.snippet_text(C("html")).alias("out")), r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '</?b>', '', 'g'), '\s+', ' ', 'g')) AS out FROM pages")
on_pages("snippet_fallback", lambda p: p.select("page_id", search.snippet(C("original_markdown"), C("translated_markdown")).alias("out")), f"SELECT page_id, {SNIP} AS out FROM w_pages")
query("snippet_headline", f"SELECT doc_id, headline FROM {HEADLINE_SQL('SELECT doc_id, text FROM documents', 'text', str(WORDS.split()))}")(lambda s, d: w.table(s, d, "documents").select("doc_id", text.headlines(text.query_terms(WORDS))("text").alias("headline")))
on_documents("fts_config", lambda d: d.select("document_id", labels.fts_config(C("target_language")).alias("config")), f"SELECT document_id, {FTS_CASE} AS config FROM w_documents")
on_table("to_tsvector", "documents", lambda t: search.postings(t.selectExpr("doc_id AS page_id", "text AS original_markdown")).select("lexeme", "page_id", "tf"), f"SELECT w AS lexeme, doc_id AS page_id, count(*) AS tf FROM (SELECT doc_id, unnest({TOK.format('text')}) AS w FROM documents) GROUP BY ALL")
query("plainto_tsquery", "SELECT 'the' AS term UNION ALL SELECT 'and'")(lambda s, d: s.createDataFrame([(t,) for t in text.query_terms("The, and the!")], "term string"))
on_table("ts_match", "documents", lambda t: t.filter(F.forall(F.array(*(text.occurrences(C("text"), x) for x in text.query_terms(WORDS))), lambda n: n > 0)).select("doc_id"), f"SELECT doc_id FROM documents WHERE list_has_all({TOK.format('text')}, ['the', 'and'])")
on_table("ts_match_postings", "documents", lambda t: search.match_postings(search.postings(t.selectExpr("doc_id AS page_id", "text AS original_markdown")), ["the", "and"]), f"SELECT doc_id AS page_id, (SELECT count(*) FROM (SELECT unnest(toks) AS x) WHERE x IN ('the', 'and')) AS tf FROM (SELECT doc_id, {TOK.format('text')} AS toks FROM documents) WHERE list_has_all(toks, ['the', 'and'])")
on_table("ts_rank_cd", "documents", lambda t: t.select("doc_id", F.round(text.occurrences(C("text"), "the") * 0.1, 6).alias("rank")), f"SELECT doc_id, round({TF.format('text', 'the')} * 0.1::DOUBLE, 6) AS rank FROM documents")
_pair = "SELECT doc_id AS page_id, text FROM documents"
query(
    "ts_rank_cd_cover",
    f"WITH places AS (SELECT page_id, pos, word FROM (SELECT page_id, unnest(toks) AS word, unnest(range(len(toks))) AS pos FROM (SELECT page_id, {TOK.format('text')} AS toks FROM ({_pair}))) WHERE word IN ('the', 'and')), "
    "pairs AS (SELECT page_id, pos, lag(pos) OVER w AS start, word <> lag(word) OVER w AS other FROM places WINDOW w AS (PARTITION BY page_id ORDER BY pos)) "
    "SELECT doc_id, round(coalesce(score, 0), 6) AS rank FROM documents LEFT JOIN (SELECT page_id, sum(0.1::DOUBLE / (pos - start)) AS score FROM pairs WHERE other GROUP BY 1) ON page_id = doc_id",
)(lambda s, d: w.table(s, d, "documents").select("doc_id", F.round(text.rank_texts(["the", "and"])(text.tokens(C("text"))), 6).alias("rank")))

# --- joins, aggregates, windows -----------------------------------------------------------------------------------------

on_both("join_pages_documents", lambda d, p: p.join(d, "document_id").select("page_id", "document_id", "title", "status"), "SELECT page_id, document_id, title, status FROM w_pages JOIN w_documents USING (document_id)")
on_both("preload_pages", lambda d, p: corpus.preload(d, p).select("document_id", F.array_join(F.transform("pages", lambda x: x["page_id"].cast("string")), ",").alias("ids")), "SELECT document_id, (SELECT string_agg(page_id::VARCHAR, ',' ORDER BY page_number) FROM w_pages p WHERE p.document_id = d.document_id) AS ids FROM w_documents d")
on_both("semi_join_ids", lambda d, p: p.join(d.filter("status = 'processing'"), "document_id", "left_semi").select("page_id"), "SELECT page_id FROM w_pages WHERE document_id IN (SELECT document_id FROM w_documents WHERE status = 'processing')")
DIRS = "SELECT source || '-' || lang || CASE WHEN doc_id % 3 = 0 THEN '-old' ELSE '' END AS name, doc_id % 50 <> 0 AS is_dir, TIMESTAMP '2024-01-10 00:00:00' + {} AS mtime FROM {}"


@query("orphan_anti_join", w.ONLY_DOCUMENTS + f", dirs AS ({DIRS.format('to_hours(doc_id % 100)', 'documents')}) SELECT name, is_dir, mtime::VARCHAR AS mtime FROM dirs WHERE is_dir AND mtime < TIMESTAMP '2024-01-13 00:00:00' - INTERVAL 24 HOURS AND name NOT IN (SELECT document_id FROM w_documents)")
def _(s, d):
    dirs = s.sql(DIRS.format("make_dt_interval(0, cast(doc_id % 100 as int))", "{t}").replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), t=w.table(s, d, "documents"))
    return ops.orphans(dirs, w.documents(s, d), F.expr("timestamp_ntz'2024-01-13 00:00:00'")).select("name", "is_dir", C("mtime").cast("string").alias("mtime"))


query("orphan_sweep", f"SELECT count(*) AS n FROM ({ORACLES['orphan_anti_join']})")(lambda s, d: QUERIES["orphan_anti_join"](s, d).agg(F.count("*").alias("n")))
query("time_cutoff", "SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 5 HOURS")(lambda s, d: (lambda e, top: e.filter(C("ts") < F.lit(top) - F.expr("INTERVAL 5 HOURS")).select("event_id"))(w.table(s, d, "events"), w.table(s, d, "events").agg(F.max("ts")).first()[0]))

PROGRESS = "SELECT d.*, CASE WHEN done IS NULL OR total_pages IS NULL OR total_pages = 0 THEN 0.0::DOUBLE ELSE done::DOUBLE / (total_pages * 2) * 100 END AS progress FROM w_documents d LEFT JOIN (SELECT document_id, sum((extraction_status = 'completed')::INT + (translation_status = 'completed')::INT) AS done FROM w_pages GROUP BY 1) USING (document_id)"
on_both("docs_with_progress", lambda d, p: corpus.with_progress(d, p).select("document_id", "title", F.round("progress", 9).alias("progress")), f"SELECT document_id, title, round(progress, 9) AS progress FROM ({PROGRESS})")
on_both("progress", lambda d, p: corpus.with_progress(d, p).select("document_id", F.round("progress", 9).alias("progress")), f"SELECT document_id, round(progress, 9) AS progress FROM ({PROGRESS})")
on_both("progress_round", lambda d, p: corpus.with_progress(d, p).select("document_id", F.round("progress", 1).alias("progress")), f"SELECT document_id, round(progress, 1) AS progress FROM ({PROGRESS})")
on_documents("progress_visible", lambda d: d.select("document_id", C("status").isin("extracting", "processing").alias("visible")), "SELECT document_id, status IN ('extracting', 'processing') AS visible FROM w_documents")
on_both("dashboard", lambda d, p: corpus.dashboard(d, p).select("document_id", "title", "status", "n_pages", F.round("progress", 9).alias("progress")), f"SELECT document_id, title, status, n_pages, round(progress, 9) AS progress FROM ({PROGRESS}) JOIN (SELECT document_id, count(*) AS n_pages FROM w_pages GROUP BY 1) USING (document_id) ORDER BY inserted_at DESC, document_id")
COMPLETION = "SELECT document_id, coalesce(o, 0) = 0 AS all_completed FROM w_documents LEFT JOIN (SELECT document_id, count(*) FILTER (translation_status <> 'completed' AND extraction_status <> 'error') AS o FROM w_pages GROUP BY 1) USING (document_id)"
on_both("all_pages_completed", lambda d, p: corpus.completion(d, p), COMPLETION)
on_both("completion_check", lambda d, p: lifecycle.completed_documents(d, corpus.completion(d, p)).select("document_id", "status"), f"SELECT document_id, CASE WHEN all_completed AND status = 'processing' THEN 'completed' ELSE status END AS status FROM w_documents JOIN ({COMPLETION}) USING (document_id)")
on_pages("not_done_predicate", lambda p: p.filter(corpus.NOT_DONE).select("page_id"), f"SELECT page_id FROM w_pages WHERE {corpus.NOT_DONE}")
on_pages("next_for_extraction", lambda p: corpus.next_page(p, "extraction"), "SELECT document_id, min(page_number) AS page_number, arg_min(page_id, page_number) AS page_id FROM w_pages WHERE extraction_status = 'pending' GROUP BY 1")
on_pages("next_for_translation", lambda p: corpus.next_page(p, "translation"), "SELECT document_id, min(page_number) AS page_number, arg_min(page_id, page_number) AS page_id FROM w_pages WHERE extraction_status = 'completed' AND translation_status = 'pending' GROUP BY 1")
on_pages("limit_one", lambda p: p.filter("extraction_status = 'pending'").select("page_id").orderBy("page_id").limit(1), "SELECT page_id FROM w_pages WHERE extraction_status = 'pending' ORDER BY page_id LIMIT 1")
on_both("embeddings_ready", lambda d, p: corpus.embeddings_ready(d, p), "SELECT document_id, coalesce(r, false) AS ready FROM w_documents LEFT JOIN (SELECT document_id, bool_or(embedding IS NOT NULL AND embedding_status = 'completed') AS r FROM w_pages GROUP BY 1) USING (document_id)")
on_both("has_thumbnail", lambda d, p: corpus.with_thumbnail(d, p), "SELECT document_id, image_path IS NOT NULL AS has_thumbnail FROM w_documents LEFT JOIN (SELECT document_id, image_path FROM w_pages WHERE page_number = 1) USING (document_id)")
on_pages("page_count", lambda p: p.groupBy("document_id").agg(F.count("*").alias("n")), "SELECT document_id, count(*) AS n FROM w_pages GROUP BY 1")
on_table("page_numbering", "documents", lambda t: t.select("doc_id", F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id")).cast("long").alias("n")), "SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents")

QUEUES = ("click", "view", "purchase", "missing")
on_table("queue_counts", "events", lambda t: ops.queue_counts(t.withColumnRenamed("event_type", "queue"), QUEUES), "SELECT " + ", ".join(f"(count(*) FILTER (event_type = '{q}'))::BIGINT AS \"{q}\"" for q in QUEUES) + " FROM events")
STATE = "CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'processing' END"
on_table("queue_stats", "events", lambda t: ops.queue_stats(t.withColumn("state", F.expr(STATE))), f"SELECT count(*) FILTER (s <> 'processing') AS total, count(*) FILTER (s = 'pending') AS pending, 0::BIGINT AS processing, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'failed') AS failed FROM (SELECT {STATE} AS s FROM events)")
on_table("health_rollup", "events", lambda t: ops.health_rollup(t, C("value") > 0.5, "event_type"), "SELECT event_type, count(*) AS total, count(*) FILTER (value > 0.5) AS healthy, count(*) FILTER (NOT coalesce(value > 0.5, false)) AS unhealthy, bool_and(coalesce(value > 0.5, false)) AS all_healthy FROM events GROUP BY 1")
on_table("telemetry_counter", "events", lambda t: ops.counter(t, "event_type"), "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
on_table("telemetry_summary", "events", lambda t: ops.summary(t, "value", "event_type").select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("least", "most", "mean", "median", "p95"))), "SELECT event_type, count(value) AS n, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean, round(quantile_disc(value, 0.5), 6) AS median, round(quantile_disc(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
on_table("telemetry_sum", "events", lambda t: ops.total(t, "value", "event_type").withColumn("total", F.round("total", 4)), "SELECT event_type, round(sum(value), 4) AS total FROM events GROUP BY 1")
on_table("module_size_having", "documents", lambda t: ops.oversized(t.select(F.concat("source", F.lit("-"), "lang").alias("file"), F.size(F.split("text", "\n")).cast("long").alias("n_lines")), 50), "SELECT source || '-' || lang AS file, sum(len(string_split(text, chr(10))))::BIGINT AS n_lines, sum(len(string_split(text, chr(10))))::BIGINT - 50 AS over FROM documents GROUP BY 1 HAVING sum(len(string_split(text, chr(10)))) > 50")
query("module_size_check", ORACLES["module_size_having"])(QUERIES["module_size_having"])
TEMPLATES, DONE_KEYS = "SELECT DISTINCT source AS domain, 'm' || doc_id % 30 AS msgid FROM documents", "SELECT lang, source AS domain, 'm' || doc_id % 30 AS msgid, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'x' END AS msgstr FROM documents"
MISSING = "WITH t AS (" + TEMPLATES + "), c AS (" + DONE_KEYS + ") SELECT l.lang, t.domain, t.msgid FROM t CROSS JOIN (SELECT DISTINCT lang FROM documents WHERE lang <> 'en') l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = l.lang AND c.domain = t.domain AND c.msgid = t.msgid AND c.msgstr <> '')"


@query("missing_translation_anti", MISSING)
def _(s, d):
    t = w.table(s, d, "documents")
    return ops.missing_translations(s.sql(TEMPLATES.replace("documents", "{t}"), t=t), s.sql(DONE_KEYS.replace("documents", "{t}"), t=t), t.select("lang"))


query("lang_cross", "WITH t AS (" + TEMPLATES + ") SELECT l.lang, t.domain, count(*) AS n FROM t CROSS JOIN (SELECT DISTINCT lang FROM documents) l GROUP BY ALL")(
    # every template meets every language, so domains are counted first, and a count meets the languages
    lambda s, d: (lambda t: s.sql(TEMPLATES.replace("documents", "{t}"), t=t).groupBy("domain").agg(F.count("*").alias("n")).crossJoin(t.select("lang").distinct()).select("lang", "domain", "n"))(w.table(s, d, "documents"))
)
query("missing_by_lang_domain", f"SELECT lang, domain, count(*) AS n FROM ({MISSING}) GROUP BY ROLLUP (lang, domain)")(lambda s, d: ops.missing_counts(QUERIES["missing_translation_anti"](s, d)))
query("translation_completeness", f"SELECT lang, count(*) AS n FROM ({MISSING}) GROUP BY 1")(lambda s, d: QUERIES["missing_translation_anti"](s, d).groupBy("lang").agg(F.count("*").alias("n")))
