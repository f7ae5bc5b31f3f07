"""The inventory, continued: scalar rules, windows, the life cycle and answers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import workload as w
from .functions import labels, resilience, sanitizing, validation
from .operators import corpus, lifecycle, logs, rag, replay
from .sources import models
from .queries import DOC_SEARCH, FTS_CASE, OWN, QUERY_VECTOR, C, by_id, docs_pages, length_of, length_vector, on_both, on_documents, on_inputs, on_pages, on_table, own_document, query, vector  # noqa: F401

TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
LANGS = ", ".join(f"'{x}'" for x in validation.LANGUAGES)
TYPES = ", ".join(f"'{x}'" for x in validation.CONTENT_TYPES)

# --- validators and sanitizers ------------------------------------------------------------------------------------------

Q = TRIM.format("query")
QUERY_ERR = f"CASE WHEN query IS NULL THEN 'Search query must be a string' WHEN length({Q}) < 3 THEN 'Query too short (minimum 3 characters)' WHEN length({Q}) > 500 THEN 'Query too long (max 500 characters)' WHEN contains({Q}, '<script>') OR contains({Q}, '</script>') THEN 'Query contains invalid characters' END"
on_inputs(
    "validate_search_query",
    lambda i: i.select("id", validation.checked(validation.search_query_error(C("query")), validation.trimmed(C("query"))).alias("c")).select("id", "c.ok", "c.value", "c.error"),
    f"SELECT id, error IS NULL AS ok, CASE WHEN error IS NULL THEN value END AS value, error FROM (SELECT id, {QUERY_ERR} AS error, {Q} AS value FROM w_inputs)",
)
L = f"lower({TRIM.format('language')})"
LANG_ERR = f"CASE WHEN language IS NULL THEN 'Language code must be a string' WHEN {L} NOT IN ({LANGS}) THEN 'Unsupported language: ' || language END"
on_inputs("validate_language", lambda i: i.select("id", validation.language_error(C("language")).alias("error"), validation.language(C("language")).alias("value")), f"SELECT id, {LANG_ERR} AS error, {L} AS value FROM w_inputs")
NAME_ERR = r"""CASE WHEN starts_with(filename, '.') THEN 'Filename cannot start with a dot' WHEN length(filename) > 255 THEN 'Filename too long (max 255 characters)' WHEN regexp_matches(filename, '[<>:"/?*|\x00-\x1f]') THEN 'Filename contains invalid characters' END"""
by_id("validate_filename", lambda: validation.filename_error(C("filename")), NAME_ERR)
SIZE_ERR = "CASE WHEN size IS NULL THEN 'File size is required' WHEN size > 100000000 THEN 'File too large (max 100MB)' END"
by_id("validate_file_size", lambda: validation.size_error(C("size")), SIZE_ERR)
TYPE_ERR = f"CASE WHEN coalesce(content_type, '') NOT IN ({TYPES}) THEN 'Invalid file type: ' || coalesce(content_type, '') END"
by_id("validate_content_type", lambda: validation.content_type_error(C("content_type")), TYPE_ERR)
on_inputs(
    "validate_file_upload",
    lambda i: i.select("id", validation.upload_error(C("filename"), C("content_type"), C("size")).alias("with_limit"), validation.upload_error_default(C("filename"), C("content_type"), C("size")).alias("configured")),
    f"SELECT id, coalesce(CASE WHEN filename IS NULL OR content_type IS NULL THEN 'Invalid file upload structure' END, {NAME_ERR}, {TYPE_ERR}, {SIZE_ERR}) AS with_limit, coalesce({NAME_ERR}, {SIZE_ERR}, {TYPE_ERR}) AS configured FROM w_inputs",
)
MISS = "array_to_string(list_filter([CASE WHEN title IS NULL THEN 'title' END, CASE WHEN filename IS NULL THEN 'original_filename' END, CASE WHEN language IS NULL THEN 'target_language' END], lambda x: x IS NOT NULL), ', ')"
FNAME = r"""regexp_replace(replace(regexp_replace({}, '\.\.', '_', 'g'), '/', '_'), '[<>:"/?*|\x01-\x1f]', '_', 'g')"""
on_inputs(
    "validate_document_attrs",
    lambda i: i.select("id", validation.document_error(C("title"), C("filename"), C("language")).alias("error"), validation.trimmed(C("title")).alias("title"), sanitizing.filename_string(C("filename")).alias("original_filename"), "language"),
    f"SELECT id, CASE WHEN {MISS} <> '' THEN 'Missing required fields: ' || {MISS} WHEN length({TRIM.format('title')}) < 1 THEN 'Title cannot be empty' ELSE {LANG_ERR} END AS error, {TRIM.format('title')} AS title, coalesce({FNAME.format('filename')}, '') AS original_filename, language FROM w_inputs",
)
MD = r"""coalesce(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '<script[^>]*>.*?</script>', '', 'gi'), '<script[^>]*>', '', 'gi'), '</script>', '', 'gi'), 'on\w+\s*=', '', 'gi'), '<img[^>]*>', '', 'gi'), '')"""
NUM = "CASE WHEN id % 11 = 0 THEN NULL ELSE id END"
on_inputs("validate_page_attrs", lambda i: i.select("id", validation.page_error(F.expr(NUM)).alias("error"), sanitizing.markdown_string(C("query")).alias("markdown")), f"SELECT id, CASE WHEN {NUM} IS NULL THEN 'Missing required fields: page_number' END AS error, {MD.format('query')} AS markdown FROM w_inputs")
STEP_ERR = "CASE WHEN {0} NOT IN ('pending', 'in_progress', 'completed', 'failed') THEN 'Invalid {1} status: ' || {0} END"
OTHER = "CASE WHEN id % 5 = 0 THEN 'error' ELSE 'pending' END"
on_inputs("validate_page_update", lambda i: i.select("id", validation.page_update_error(F.expr(NUM), C("step"), F.expr(OTHER)).alias("error")), f"SELECT id, coalesce(CASE WHEN {NUM} IS NULL THEN 'Missing required fields: page_number' END, {STEP_ERR.format('step', 'extraction')}, {STEP_ERR.format('(' + OTHER + ')', 'translation')}) AS error FROM w_inputs")
by_id("sanitize_filename", lambda: sanitizing.filename(C("filename")), r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(filename, '\.\.', '_', 'g'), '[^\w\-.]', '_', 'g'), '\s+', '_', 'g'), '_+', '_', 'g'), '.')")
by_id("sanitize_filename_string", lambda: sanitizing.filename_string(C("filename")), f"coalesce({FNAME.format('filename')}, '')")
on_table("sanitize_markdown_string", "pages", lambda t: t.select("page_id", sanitizing.markdown_string(C("html")).alias("out")), f"SELECT page_id, {MD.format('html')} AS out FROM pages")
on_table("sanitize_markdown", "pages", lambda t: t.select("page_id", sanitizing.markdown(C("html")).alias("out")), r"""SELECT page_id, left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>', '', 'gi'), '</script>', '', 'gi'), 'javascript:', '', 'gi'), 'data:[^"\s]*]', '', 'gi'), 50000) AS out FROM pages""")
FENCED = "CASE doc_id % 3 WHEN 0 THEN '```markdown' || chr(10) || text || chr(10) || '```  ' WHEN 1 THEN '  ' || text || ' ' ELSE text || '```' END"
UNFENCED = r"regexp_replace(regexp_replace({}, '\A```[^\n]*\n', ''), '\n?```\s*\z', '')".format(FENCED)
on_table("strip_code_fences", "documents", lambda t: t.select("doc_id", sanitizing.code_fences(F.expr(FENCED)).alias("out")), f"SELECT doc_id, {TRIM.format(UNFENCED)} AS out FROM documents")
on_inputs("title_from_filename", lambda i: i.select("id", labels.title_of(C("filename")).alias("out")), r"SELECT id, regexp_replace(regexp_replace(string_split(filename, '/')[-1], '\.pdf$', ''), '[_-]+', ' ', 'g') AS out FROM w_inputs")

# --- labels, paths, paging ----------------------------------------------------------------------------------------------


def case(key: str, table: dict, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


on_documents(
    "status_color", lambda d: d.select("document_id", labels.status_color(C("status")).alias("color"), labels.status_text(C("status")).alias("text")), f"SELECT document_id, {case('status', labels.STATUS_COLORS, chr(39) + 'badge-ghost' + chr(39))} AS color, {case('status', labels.STATUS_TEXTS, chr(39) + 'Unknown' + chr(39))} AS text FROM w_documents"
)
on_documents("language_name_ui", lambda d: d.select("document_id", labels.language_name(C("target_language")).alias("name")), f"SELECT document_id, {case('target_language', labels.LANGUAGE_NAMES, 'target_language')} AS name FROM w_documents")
by_id("language_name_prompt", lambda: labels.prompt_language(C("language")), case("language", labels.PROMPT_LANGUAGES, "language"))
HEADER = "CASE doc_id % 4 WHEN 0 THEN 'xx-YY,' || upper(lang) || '-AA;q=0.8, en;q=0.5' WHEN 1 THEN lang || '-x' WHEN 2 THEN 'zz, qq;q=1' ELSE 'ru;q=0.9,pl-PL' END"
SUPPORTED = ", ".join(f"'{x}'" for x in labels.LOCALES)
on_table(
    "accept_language",
    "documents",
    lambda t: t.select("doc_id", labels.accept_language(F.expr(HEADER)).alias("locale")),
    f"SELECT doc_id, coalesce(list_filter(list_transform(string_split({HEADER}, ','), lambda p: lower(string_split(trim(string_split(p, ';')[1]), '-')[1])), lambda c: c IN ({SUPPORTED}))[1], 'en') AS locale FROM documents",
)
by_id("session_locale", lambda: labels.session_locale(C("language")), f"CASE WHEN language IN ({SUPPORTED}) THEN language ELSE 'en' END")
ORIGIN, PAGE_ARG = "CASE id % 3 WHEN 0 THEN 'index' ELSE 'search' END", "CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '1' ELSE '3' END"
by_id("back_url", lambda: labels.back_url(F.expr(ORIGIN), F.expr("'w' || id"), F.expr(PAGE_ARG)), f"CASE WHEN {ORIGIN} = 'search' THEN '/search?q=w' || id || CASE WHEN {PAGE_ARG} IS NOT NULL AND {PAGE_ARG} <> '1' THEN '&page=' || {PAGE_ARG} ELSE '' END ELSE '/' END")
on_documents("path_join", lambda d: d.select("document_id", labels.document_dir(C("document_id")).alias("dir"), labels.pages_dir(C("document_id")).alias("pages")), "SELECT document_id, 'uploads/documents/' || document_id AS dir, 'uploads/documents/' || document_id || '/pages' AS pages FROM w_documents")
on_documents("pdf_path", lambda d: d.select("document_id", labels.pdf_path(C("document_id"), F.when(C("status") == "error", "tmp")).alias("path")), "SELECT document_id, CASE status WHEN 'error' THEN 'tmp' ELSE 'uploads' END || '/' || document_id || '.pdf' AS path FROM w_documents")
KIND = "CASE id % 4 WHEN 0 THEN 'too_large' WHEN 1 THEN 'too_many_files' WHEN 2 THEN 'not_accepted' ELSE 'odd' END"
by_id("upload_error_label", lambda: labels.upload_error_label(F.expr(KIND)), case(f"({KIND})", labels.UPLOAD_ERRORS, f"'Error: ' || {KIND}"))
CHAT = {"empty_question": "Please enter a question", "database_error": "Search failed, please try again"}
CHAT_KIND = "CASE id % 3 WHEN 0 THEN 'empty_question' WHEN 1 THEN 'database_error' ELSE 'other' END"
by_id("chat_error_label", lambda: labels.lookup(F.expr(CHAT_KIND), CHAT, F.lit("The question could not be answered")), case(f"({CHAT_KIND})", CHAT, "'The question could not be answered'"))
RAW_PAGE = "CASE id % 6 WHEN 0 THEN '3' WHEN 1 THEN '-2' WHEN 2 THEN 'x' WHEN 3 THEN NULL WHEN 4 THEN '0' ELSE '12' END"
PARSED = f"CASE WHEN try_cast({RAW_PAGE} AS BIGINT) > 0 THEN try_cast({RAW_PAGE} AS BIGINT) ELSE 1 END"
on_inputs(
    "pagination",
    lambda i: i.withColumn("p", labels.page_number_of(F.expr(RAW_PAGE))).select("id", "p", labels.pagination(C("id"), C("p")).alias("x")).select("id", "p", "x.offset", "x.pages", "x.first", "x.last"),
    f'SELECT id, p, (p - 1) * 20 AS "offset", greatest(1, ceil(id / 20))::BIGINT AS pages, (p - 1) * 20 + 1 AS first, least(p * 20, id) AS last FROM (SELECT id, {PARSED} AS p FROM w_inputs)',
)
TOTAL = "CASE WHEN id % 7 = 0 THEN NULL ELSE id % 10 END"
by_id("clamp_page", lambda: labels.clamped_page(C("id") % 15 - 2, F.expr(TOTAL)), f"greatest(1, least(id % 15 - 2, coalesce({TOTAL}, 1)))::BIGINT")
by_id("zoom_step", lambda: labels.zoomed(C("id") % 200, C("id") % 5 - 2).cast("long"), "greatest(50, least(200, id % 200 + 25 * (id % 5 - 2)))::BIGINT")
FIELD, DIR = "CASE id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'inserted_at' ELSE 'x' END", "CASE id % 2 WHEN 0 THEN 'asc' ELSE 'desc' END"
by_id("sort_label", lambda: labels.sort_label(F.expr(FIELD), F.expr(DIR)), case(f"(({FIELD}) || ' ' || ({DIR}))", {" ".join(k): v for k, v in labels.SORT_LABELS.items()}, "'Sort'"))
query("language_options_sort", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in labels.LANGUAGE_NAMES.items()) + ") t(code, name) ORDER BY name")(lambda s, d: s.createDataFrame(list(labels.LANGUAGE_NAMES.items()), "code string, name string").orderBy("name"))
ESC = r"""replace(replace(replace(text || '\n\"x\\', '\n', chr(10)), '\"', '"'), '\\', '\')"""
on_table("po_unescape", "documents", lambda t: t.select("doc_id", labels.po_unescaped(F.concat(C("text"), F.lit('\\n\\"x\\\\'))).alias("out")), f"SELECT doc_id, {ESC} AS out FROM documents")
on_table("truncate", "documents", lambda t: t.select("doc_id", labels.truncated(C("text"), 30).alias("out")), "SELECT doc_id, CASE WHEN length(text) > 30 THEN left(text, 27) || '...' ELSE text END AS out FROM documents")
on_inputs(
    "upload_rules",
    lambda i: i.select("id", F.coalesce(C("size") <= 100_000_000, F.lit(False)).alias("size_ok"), F.coalesce(F.lower(F.regexp_extract("filename", r"\.[^./]*$", 0)).isin(".pdf", ".docx", ".doc", ".odt", ".rtf"), F.lit(False)).alias("type_ok"), ((C("id") % 25) < 10).alias("count_ok")),
    r"SELECT id, coalesce(size <= 100000000, false) AS size_ok, coalesce(lower(regexp_extract(filename, '\.[^./]*$')) IN ('.pdf', '.docx', '.doc', '.odt', '.rtf'), false) AS type_ok, id % 25 < 10 AS count_ok FROM w_inputs",
)

# --- rules on pages -----------------------------------------------------------------------------------------------------

E_, T_ = "extraction_status", "translation_status"
on_pages("can_process_page", lambda p: p.select("page_id", corpus.can_process_page(C(E_), C(T_)).alias("ok")), "SELECT page_id, extraction_status IN ('pending', 'error') OR (extraction_status = 'completed' AND translation_status <> 'completed') AS ok FROM w_pages")
on_documents("can_process_document", lambda d: d.select("document_id", corpus.can_process_document(C("status")).alias("ok")), "SELECT document_id, status IN ('queued', 'extracting') AS ok FROM w_documents")
on_pages("can_reprocess", lambda p: p.select("page_id", corpus.can_reprocess(C(E_), C(T_)).alias("ok")), "SELECT page_id, extraction_status IN ('completed', 'error') OR translation_status = 'error' AS ok FROM w_pages")
SHOW = "CASE WHEN page_id % 2 = 0 THEN extraction_status = 'completed' AND original_markdown IS NOT NULL ELSE translation_status = 'completed' AND translated_markdown IS NOT NULL END"
_show = lambda: (C(E_), C(T_), C("original_markdown"), C("translated_markdown"), C("page_id") % 2 == 0)
on_pages("show_content", lambda p: p.select("page_id", corpus.shows_content(*_show()).alias("ok")), f"SELECT page_id, {SHOW} AS ok FROM w_pages")
on_pages(
    "page_view_state",
    lambda p: p.select("page_id", corpus.view_state(*_show()).alias("v")).select("page_id", "v.extracting", "v.translating", "v.pending", "v.error", "v.content"),
    f"SELECT page_id, extraction_status = 'processing' AS extracting, page_id % 2 <> 0 AND extraction_status = 'completed' AND translation_status = 'processing' AS translating, extraction_status = 'pending' AS pending, extraction_status = 'error' OR translation_status = 'error' AS error, {SHOW} AS content FROM w_pages",
)
on_pages("embedding_choice", lambda p: p.select("page_id", F.length(corpus.embedding_text(C("original_markdown"), C("translated_markdown"), False)).cast("long").alias("n")), "SELECT page_id, length(coalesce(translated_markdown, original_markdown)) AS n FROM w_pages")
on_pages(
    "embed_worker",
    # the vector of a text holds its length; some texts are missing
    lambda p: models.embedded_pages(p.withColumn("original_markdown", F.expr("CASE WHEN page_id % 6 <> 0 THEN original_markdown END")), length_vector, attempts=1).select("page_id", length_of(C("embedding")).alias("n"), "embedding_status"),
    "SELECT page_id, CASE WHEN page_id % 6 <> 0 THEN length(original_markdown) END AS n, 'completed' AS embedding_status FROM w_pages WHERE extraction_status = 'completed'",
)
on_pages("page_fsm", lambda p: p.select("page_id", lifecycle.page_action(C(E_), C(T_), C("original_markdown")).alias("action")), "SELECT page_id, CASE WHEN extraction_status = 'pending' THEN 'extract' WHEN extraction_status = 'completed' AND translation_status = 'pending' THEN CASE WHEN coalesce(original_markdown, '') <> '' THEN 'translate' ELSE 'complete_empty' END ELSE 'skip' END AS action FROM w_pages")
MODELS = "CASE id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'zz' END"
by_id("model_allow_list", lambda: F.array_contains(F.array(F.lit("a"), F.lit("b")), F.expr(MODELS)) & F.array_contains(F.array(F.lit("a"), F.lit("b")), F.expr("CASE id % 3 WHEN 0 THEN 'a' ELSE 'c' END")), f"list_contains(['a', 'b'], {MODELS}) AND list_contains(['a', 'b'], CASE id % 3 WHEN 0 THEN 'a' ELSE 'c' END)")
by_id("model_override", lambda: F.coalesce("language", F.lit("default-model")), "coalesce(language, 'default-model')")
by_id("to_float", lambda: F.coalesce(C("size").cast("double"), F.lit(0.0)), "coalesce(size::DOUBLE, 0.0::DOUBLE)")

# --- resilience and life cycle ------------------------------------------------------------------------------------------

by_id("backoff", lambda: resilience.backoff(C("id") % 12, jitter=0), "least(2000 * pow(2, id % 12), 30000)::BIGINT")
by_id("backoff_jitter_in_range", lambda: F.abs(resilience.backoff(C("id") % 8, seed=C("id")) - resilience.backoff(C("id") % 8, jitter=0)) <= F.round(resilience.backoff(C("id") % 8, jitter=0) * 0.25), "true")
MSG = "CASE id % 9 WHEN 0 THEN 'connection timeout' WHEN 1 THEN 'HTTP 500 error' WHEN 2 THEN 'rate limit exceeded' WHEN 3 THEN 'file not found' WHEN 4 THEN 'model x is not here' WHEN 5 THEN 'odd thing' WHEN 6 THEN 'invalid timeout' WHEN 7 THEN 'Timeout' ELSE 'HTTP 404' END"
RETRY = " OR ".join(f"contains(m, '{x}')" for x in resilience.RETRYABLE_PARTS)
PERM = " OR ".join(f"contains(m, '{x}')" for x in resilience.PERMANENT_PARTS)
CLASS = f"CASE WHEN {RETRY} THEN 'retryable' WHEN {PERM} OR (contains(m, 'model') AND contains(m, 'not')) THEN 'permanent' ELSE 'unknown' END"
CODE = "[200, 429, 500, 503, 404, 400, 599, 301][1 + id % 8]"
CODE_CLASS = "CASE WHEN code = 429 OR code BETWEEN 500 AND 599 THEN 'retryable' WHEN code BETWEEN 400 AND 499 THEN 'permanent' ELSE 'unknown' END"
on_inputs(
    "error_classify",
    lambda i: i.select("id", resilience.error_class(F.expr(MSG)).alias("message_class"), resilience.status_class(F.expr("element_at(array(200, 429, 500, 503, 404, 400, 599, 301), int(1 + id % 8))")).alias("code_class")),
    f"SELECT id, {CLASS} AS message_class, {CODE_CLASS} AS code_class FROM (SELECT id, {MSG} AS m, {CODE} AS code FROM w_inputs)",
)
on_inputs("retryable", lambda i: i.select("id", resilience.retryable(resilience.error_class(F.expr(MSG))).alias("retryable"), (resilience.error_class(F.expr(MSG)) == "permanent").alias("permanent")), f"SELECT id, {CLASS} <> 'permanent' AS retryable, {CLASS} = 'permanent' AS permanent FROM (SELECT id, {MSG} AS m FROM w_inputs)")
on_inputs(
    "retry_loop",
    lambda i: i.select("id", resilience.retry_decision(resilience.error_class(F.expr(MSG)), C("id") % 5, 3, C("id") % 13 == 0).alias("decision")),
    f"SELECT id, CASE WHEN id % 13 = 0 OR {CLASS} = 'permanent' THEN 'fail' WHEN id % 5 < 3 THEN 'retry' ELSE 'fail' END AS decision FROM (SELECT id, {MSG} AS m FROM w_inputs)",
)


def fsm_sql() -> str:
    parts = {"status": [], "result": [], "error": []}
    for name, (valid, to, said, errors) in lifecycle.TRANSITIONS.items():
        may = "status NOT IN (" + ", ".join(f"'{x}'" for x in errors) + ")" if valid is None else "status IN (" + ", ".join(f"'{x}'" for x in sorted(valid)) + ")"
        parts["status"].append(f"WHEN event = '{name}' AND {may} THEN '{to}'")
        parts["result"].append(f"WHEN event = '{name}' AND {may} THEN '{said}'")
        parts["error"] += [f"WHEN event = '{name}' AND status = '{k}' THEN '{v}'" for k, v in errors.items()] + [f"WHEN event = '{name}' AND NOT ({may}) THEN 'invalid_status'"]
    return ", ".join(f"CASE {' '.join(v)} {'ELSE status ' if k == 'status' else ''}END AS {k}" for k, v in parts.items())


on_documents(
    "document_fsm",
    lambda d: d.select("document_id", "status", F.explode(F.array(*(F.lit(e) for e in lifecycle.TRANSITIONS))).alias("event")).select("document_id", "event", lifecycle.transition(C("status"), C("event")).alias("x")).select("document_id", "event", "x.status", "x.result", "x.error"),
    f"SELECT document_id, event, {fsm_sql()} FROM w_documents, (SELECT unnest(['start', 'complete', 'fail', 'reset']) AS event)",
)
on_documents("document_fsm_silent", lambda d: d.select("document_id", lifecycle.silently(C("status"), "processing").alias("processing"), lifecycle.silently(C("status"), "queued").alias("queued")), "SELECT document_id, CASE WHEN status IN ('uploading', 'extracting', 'queued') THEN 'processing' ELSE status END AS processing, CASE WHEN status = 'extracting' THEN 'queued' ELSE status END AS queued FROM w_documents")
LOG = "SELECT CASE WHEN event_id % 2 = 0 THEN 'src1-en' WHEN event_id % 97 = 5 THEN 'none' ELSE 'src' || CAST(event_id % 20 AS VARCHAR(2)) || '-en' END AS document_id, event_id AS seq, CASE event_id * 7 % 11 % 5 WHEN 0 THEN 'start' WHEN 1 THEN 'complete' WHEN 2 THEN 'fail' WHEN 3 THEN 'reset' ELSE 'other' END AS event FROM {}"


# a status after an event follows from the one before, so SQL steps through each document's events
@query(
    "document_fsm_log",
    w.ONLY_DOCUMENTS.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", l AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seq) AS n FROM ({LOG.format('events')})),
s AS (SELECT document_id, 0::BIGINT AS n, status FROM (SELECT DISTINCT document_id FROM l) LEFT JOIN w_documents USING (document_id)
  UNION ALL SELECT document_id, l.n, CASE WHEN event = 'start' AND status IN ('queued', 'extracting') THEN 'processing' WHEN event = 'complete' AND status = 'processing' THEN 'completed' WHEN event = 'fail' AND status = 'processing' THEN 'error'
    WHEN event = 'reset' AND status <> 'completed' THEN 'queued' ELSE status END FROM s JOIN l USING (document_id) WHERE l.n = s.n + 1)
SELECT document_id, seq, event, status, result, coalesce(error, CASE WHEN status IS NULL THEN 'document_not_found' END) AS error FROM (
  SELECT document_id, seq, event, {fsm_sql()} FROM (SELECT l.document_id, seq, event, s.status FROM l JOIN s ON s.document_id = l.document_id AND s.n = l.n - 1))""",
)
def _(s, d):
    """A log in which one document has half of all events."""
    log = s.sql(LOG.format("{t}"), t=w.table(s, d, "events"))
    return replay.replayed(log, w.documents(s, d)).select("document_id", "seq", "event", "status", "result", "error")


FAILURES = "FROM events WHERE value > 60"
on_table(
    "breaker_window",
    "events",
    lambda t: lifecycle.breaker_opens(t.filter("value > 60"), 3, 14_400, "event_type").select("event_id", "n", "open"),
    f"SELECT event_id, n, n > 3 AS open FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 14400 SECONDS PRECEDING AND CURRENT ROW) AS n {FAILURES})",
)
# failures are values above a limit; an opening is found from the time of the failure that is one more than the tolerated number back, and the next one only after the pause
OPENINGS = """c AS (SELECT event_type AS fuse, epoch_us(ts) AS us, event_id AS id, value > 60 AS failed, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT *, lag(us, 3) OVER (PARTITION BY fuse ORDER BY n) AS back FROM c WHERE failed),
o(fuse, n, opened) AS (
  SELECT fuse, min(n), min(us) FROM f WHERE back >= us - 14400000000 GROUP BY fuse
  UNION ALL
  SELECT * FROM (SELECT o.fuse, (SELECT min(f.n) FROM f WHERE f.fuse = o.fuse AND f.back >= f.us - 14400000000 AND f.back >= o.opened + 1800000000) AS n,
    (SELECT min(f.us) FROM f WHERE f.fuse = o.fuse AND f.back >= f.us - 14400000000 AND f.back >= o.opened + 1800000000) AS opened FROM o) WHERE n IS NOT NULL)"""


@query(
    "circuit_breaker",
    f"WITH RECURSIVE {OPENINGS} SELECT c.fuse, c.us AS \"at\", c.id, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.fuse = c.fuse AND c.n > o.n AND c.us < o.opened + 1800000000) THEN 'rejected' WHEN failed THEN 'failed' ELSE 'ok' END AS outcome, EXISTS (SELECT 1 FROM o WHERE o.fuse = c.fuse AND o.n = c.n) AS opened FROM c",
)
def _(s, d):
    """Every call of every fuse: more than three failures in four hours open it for half an hour."""
    calls = w.table(s, d, "events").select(C("event_type").alias("fuse"), F.unix_micros(C("ts").cast("timestamp")).alias("at"), C("event_id").alias("id"), (C("value") > 60).alias("failed"))
    return logs.breaker_calls(calls, 3, 14_400, 1_800)


@query("breaker_status", "SELECT f AS fuse, coalesce((SELECT arg_max(CASE WHEN value > 10 THEN 'blown' ELSE 'ok' END, ts) FROM events WHERE event_type = f), 'not_found') AS state FROM (SELECT unnest(['error', 'click', 'none']) AS f)")
def _(s, d):
    changes = w.table(s, d, "events").select(C("event_type").alias("fuse"), "ts", F.when(C("value") > 10, "blown").otherwise("ok").alias("state"))
    return lifecycle.breaker_status(changes, s.createDataFrame([("error",), ("click",), ("none",)], "fuse string"))


EDGES = "SELECT event_id, coalesce(value <= 10 AND lag(value > 10) OVER (PARTITION BY event_type ORDER BY ts), false) AS reset FROM events"
on_table("recovery_edge", "events", lambda t: lifecycle.recovery_edges(t, "event_type", "ts", C("value") <= 10).select("event_id", "reset"), EDGES)
on_table("health_poll", "events", lambda t: lifecycle.recovery_edges(t, "event_type", "ts", C("value") <= 10).groupBy("event_type").agg(F.sum(C("reset").cast("long")).alias("resets")), f"SELECT event_type, sum(reset::INT)::BIGINT AS resets FROM ({EDGES}) JOIN events USING (event_id) GROUP BY 1")
on_table("json_get", "events", lambda t: t.select("event_id", F.get_json_object("props", "$.k").alias("k")), "SELECT event_id, props->>'$.k' AS k FROM events")
on_table("job_filter_json", "events", lambda t: t.filter((F.get_json_object("props", "$.k") == "42") & C("event_type").isin("click", "view")).select("event_id"), "SELECT event_id FROM events WHERE props->>'$.k' = '42' AND event_type IN ('click', 'view')")
on_table("job_filter_any", "events", lambda t: t.filter(F.get_json_object("props", "$.k").isin("1", "2", "3")).select("event_id"), "SELECT event_id FROM events WHERE props->>'$.k' IN ('1', '2', '3')")
on_table("job_reprocess_args", "events", lambda t: t.select("event_id", lifecycle.reprocess_args(C("event_id"), F.when(C("event_id") % 2 == 0, "m1"), F.when(C("event_id") % 3 == 0, "m2")).alias("args")), """SELECT event_id, '{"page_id":"' || event_id || '"' || CASE WHEN event_id % 2 = 0 THEN ',"extraction_model":"m1"' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN ',"translation_model":"m2"' ELSE '' END || '}' AS args FROM events""")
PRI = "CASE WHEN event_id % 5 = 0 THEN 1 ELSE 2 END"
on_table("job_priority", "events", lambda t: t.withColumn("priority", F.expr(PRI)).orderBy("priority", "ts", "event_id").select("event_id", "priority"), f"SELECT event_id, {PRI} AS priority FROM events ORDER BY priority, ts, event_id")
on_table(
    "priority_queue",
    "events",
    lambda t: lifecycle.queued(t.select(C("event_id").alias("seq"), "user_id", F.when(C("event_type") == "error", "high").otherwise("normal").alias("priority")), 10, "user_id").select("seq", C("place").cast("long").alias("place"), "accepted"),
    # a full queue refuses; among the accepted the high ones come first, the newest before older ones
    "SELECT seq, CASE WHEN accepted THEN row_number() OVER (PARTITION BY user_id, accepted ORDER BY high DESC, CASE WHEN high = 1 THEN -seq ELSE seq END) END AS place, accepted FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 10 AS accepted FROM (SELECT event_id AS seq, user_id, (event_type = 'error')::INT AS high FROM events))",
)
JOBS = "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN '{\"page_id\":\"' || event_id || '\"}' WHEN 1 THEN '{\"document_id\":\"src' || event_id % 20 || '-en\"}' ELSE '{}' END AS args, CASE event_id % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'executing' WHEN 2 THEN 'retryable' ELSE 'scheduled' END AS state FROM {t}"


@query(
    "cancel_document",
    w.BOTH
    + ", j AS ("
    + JOBS.replace("{t}", "events")
    + "), own AS (SELECT document_id AS id FROM w_documents WHERE status = 'processing' UNION SELECT page_id::VARCHAR FROM w_pages WHERE document_id IN (SELECT document_id FROM w_documents WHERE status = 'processing')) SELECT id, CASE WHEN state IN ('available', 'scheduled', 'retryable') AND coalesce(args->>'$.page_id', args->>'$.document_id') IN (SELECT id FROM own) THEN 'cancelled' ELSE state END AS state FROM j",
)
def _(s, d):
    doc, p = docs_pages(s, d)
    jobs = s.sql(JOBS.replace("'{}'", "'{{}}'").replace("'{\"", "'{{\"").replace("\"}'", "\"}}'"), t=w.table(s, d, "events"))
    return lifecycle.cancelled(jobs, doc.filter("status = 'processing'").select("document_id"), p.select("page_id", "document_id")).select("id", "state")


OPS = "CASE event_id % 8 WHEN 3 THEN 'next' WHEN 4 THEN 'complete' WHEN 5 THEN 'timeout' WHEN 6 THEN 'remove' WHEN 7 THEN CASE WHEN event_id % 5 = 0 THEN 'clear' ELSE 'next' END ELSE 'add' END"


@query(
    "queue_ops",
    f"""WITH RECURSIVE e AS (SELECT user_id % 40 AS queue, event_id AS seq, row_number() OVER w AS n, {OPS} AS op, CASE WHEN {OPS} = 'add' THEN event_id ELSE lag(event_id) OVER w END AS id, event_type = 'error' AS high FROM events WINDOW w AS (PARTITION BY user_id % 40 ORDER BY event_id)),
s AS (SELECT queue, NULL::BIGINT AS seq, 0::BIGINT AS n, []::BIGINT[] AS q, NULL::VARCHAR AS result, 0::BIGINT AS completed, 0::BIGINT AS failed FROM e GROUP BY queue
  UNION ALL
  SELECT e.queue, e.seq, e.n,
    CASE op WHEN 'add' THEN CASE WHEN len(q) >= 10 THEN q WHEN high THEN list_prepend(e.id, q) ELSE list_append(q, e.id) END WHEN 'next' THEN q[2:] WHEN 'remove' THEN list_filter(q, lambda x: e.id IS NULL OR x <> e.id) ELSE q END,
    CASE op WHEN 'add' THEN CASE WHEN len(q) >= 10 THEN 'queue_full' ELSE 'ok' END WHEN 'next' THEN coalesce(q[1]::VARCHAR, 'empty') ELSE 'ok' END,
    CASE op WHEN 'complete' THEN completed + 1 WHEN 'clear' THEN 0 ELSE completed END, failed + (op = 'timeout')::BIGINT
  FROM s JOIN e ON e.queue = s.queue AND e.n = s.n + 1)
SELECT queue, seq, result, len(q) AS pending, completed, failed FROM s WHERE n > 0""",
)
def _(s, d):
    """Every operation on every queue: its result and what the queue holds after it."""
    events = w.table(s, d, "events").select((C("user_id") % 40).alias("queue"), C("event_id").alias("seq"), F.expr(OPS).alias("op"), (C("event_type") == "error").alias("high"))
    target = F.when(C("op") == "add", C("seq")).otherwise(F.lag("seq").over(Window.partitionBy("queue").orderBy("seq")))
    return logs.queue_log(events.withColumn("id", target))


KINDS = "CASE event_id % 5 WHEN 1 THEN 'reply' WHEN 2 THEN 'reply' WHEN 3 THEN 'error' ELSE 'ask' END"


@query(
    "chat_async",
    f"""WITH RECURSIVE e AS (SELECT user_id % 40 AS conversation, event_id AS seq, row_number() OVER w AS n, {KINDS} AS kind, CASE WHEN {KINDS} = 'ask' THEN event_id ELSE lag(event_id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END) OVER w END AS ref, event_id % 11 <> 0 AS worded FROM events WINDOW w AS (PARTITION BY user_id % 40 ORDER BY event_id)),
s AS (SELECT conversation, NULL::BIGINT AS seq, 0::BIGINT AS n, NULL::BIGINT AS waiting, NULL::VARCHAR AS outcome, 0::BIGINT AS history FROM e GROUP BY conversation
  UNION ALL
  SELECT e.conversation, e.seq, e.n,
    CASE WHEN kind = 'ask' THEN CASE WHEN waiting IS NULL AND worded THEN e.ref ELSE waiting END WHEN waiting = e.ref THEN NULL ELSE waiting END,
    CASE WHEN kind = 'ask' THEN CASE WHEN waiting IS NULL AND worded THEN 'asked' ELSE 'ignored' END WHEN waiting IS NULL OR e.ref IS NULL OR waiting <> e.ref THEN 'stale' WHEN kind = 'error' THEN 'failed' ELSE 'answered' END,
    CASE WHEN kind = 'reply' AND waiting = e.ref THEN least(16, history + 2) ELSE history END
  FROM s JOIN e ON e.conversation = s.conversation AND e.n = s.n + 1)
SELECT conversation, seq, outcome, history FROM s WHERE n > 0""",
)
def _(s, d):
    """Questions and answers of many conversations: one question at a time, answers to others are stale."""
    events = w.table(s, d, "events").select((C("user_id") % 40).alias("conversation"), C("event_id").alias("seq"), F.expr(KINDS).alias("kind"), F.when(C("event_id") % 11 != 0, "why?").otherwise("  ").alias("text"))
    order = Window.partitionBy("conversation").orderBy("seq")
    back = F.when(C("seq") % 3 == 0, F.lag("seq", 2).over(order)).otherwise(F.lag("seq").over(order))
    return logs.chat_log(events.withColumn("ref", F.when(C("kind") == "ask", C("seq")).otherwise(back)))


JOB = "event_id AS id, CASE user_id % 5 WHEN 0 THEN 'pdf_extraction' WHEN 1 THEN 'llm_processing' WHEN 2 THEN 'embedding_generation' WHEN 3 THEN 'health_check' ELSE 'other' END AS queue, CASE WHEN event_id % 900 = 0 THEN 'executing' WHEN event_id % 4 = 0 THEN 'retryable' WHEN event_id % 4 = 1 THEN 'completed' ELSE 'available' END AS state, CAST(event_id % 5 AS INT) AS attempt, CAST(event_id % 3 AS INT) AS priority"


@query(
    "job_queues",
    f"""WITH j AS (SELECT {JOB} FROM events), q AS (SELECT * FROM (VALUES ('pdf_extraction', 1), ('llm_processing', 1), ('embedding_generation', 5), ('health_check', 1)) t(queue, places)),
b AS (SELECT queue, count(*) AS busy FROM j WHERE state = 'executing' GROUP BY 1),
r AS (SELECT id, row_number() OVER (PARTITION BY queue ORDER BY priority, id) AS n FROM j WHERE state IN ('available', 'retryable') AND attempt < 3)
SELECT id, CASE WHEN state = 'executing' THEN 'goes_on' WHEN state NOT IN ('available', 'retryable') THEN 'none' WHEN attempt >= 3 THEN 'discard' WHEN n <= coalesce(places, 0) - coalesce(busy, 0) THEN 'run' ELSE 'wait' END AS decision
FROM j LEFT JOIN q USING (queue) LEFT JOIN b USING (queue) LEFT JOIN r USING (id)""",
)
def _(s, d):
    from .operators import health

    return health.assigned(w.table(s, d, "events").selectExpr(*w._columns(JOB))).select("id", "decision")


def _cron(t):
    from .operators import health

    return t.select("event_id", health.cron_matches(C("ts"), health.CRON["health_check"]).alias("health"), health.cron_matches(C("ts"), "*/15,7 8-17 * * 1-5").alias("office"))


on_table("cron_health", "events", _cron, "SELECT event_id, true AS health, (minute(ts) % 15 = 0 OR minute(ts) = 7) AND hour(ts) BETWEEN 8 AND 17 AND dayofweek(ts) BETWEEN 1 AND 5 AS office FROM events")


@query("sweep_schedule", "SELECT max(ts)::VARCHAR AS last_sweep, count(*) AS sweep_count, arg_max(CASE WHEN value > 60 THEN 'error: ' || event_type ELSE 'ok: ' || user_id END, ts) AS last_result, (max(ts) + INTERVAL 6 HOURS)::VARCHAR AS next_sweep FROM events WHERE ts IN (SELECT ts FROM events GROUP BY ts HAVING count(*) = 1)")
def _(s, d):
    from .operators import health

    events = w.table(s, d, "events")
    sweeps = events.join(events.groupBy("ts").count().filter("count = 1").select("ts"), "ts")  # one sweep at a time
    status = health.sweep_status(sweeps.select("ts", C("user_id").alias("n"), F.when(C("value") > 60, C("event_type")).alias("error")))
    return status.select(*(C(c).cast("string").alias(c) if c.endswith("_sweep") else C(c) for c in status.columns))


on_documents("topic_broadcast", lambda d: lifecycle.topics(d.select("document_id", "status")), "SELECT document_id, status, unnest(['document:' || document_id, 'documents']) AS topic FROM w_documents")
on_table("task_timeout", "events", lambda t: t.select("event_id", lifecycle.stale(C("ts"), F.expr("timestamp'2024-01-15 00:00:00'"), 360).alias("stale")), "SELECT event_id, ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 360 SECONDS AS stale FROM events")
on_both("startup_recovery", lambda d, p: lifecycle.recovered(d, p), "SELECT page_id, document_id FROM w_pages JOIN w_documents d USING (document_id) WHERE d.status IN ('processing', 'queued') AND extraction_status = 'pending'")

# --- answers ------------------------------------------------------------------------------------------------------------

LAST = "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS n FROM conversations) WHERE n <= {}"
on_table("last_n_history", "conversations", lambda t: rag.last_messages(t, 8), LAST.format(8))
on_table("session_history_cap", "conversations", lambda t: rag.last_messages(t, 16), LAST.format(16))
on_table(
    "build_messages",
    "conversations",
    lambda t: rag.history(t).select("conv_id", rag.build_messages(F.lit("sys"), C("history"), F.lit("q")).alias("m")).select("conv_id", F.size("m").cast("long").alias("n"), F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|").alias("messages")),
    "SELECT conv_id, count(*) + 2 AS n, 'system:sys|' || string_agg(role || ':' || text, '|' ORDER BY turn) || '|user:q' AS messages FROM (" + LAST.format(8) + ") GROUP BY conv_id",
)
FOUND = w.ONLY_PAGES + ", f AS (SELECT * FROM " + DOC_SEARCH.format("x").replace("'x'", OWN) + " WHERE similarity >= -0.2 ORDER BY similarity DESC, page_id LIMIT 3)"
BODY = "coalesce(translated_markdown, original_markdown, '')"
CONTEXT = f"SELECT coalesce(string_agg('[Page ' || page_number || ']' || chr(10) || {TRIM.format(BODY)}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY similarity DESC, page_id) FILTER ({BODY} <> ''), '') AS context FROM f"


def found(s, d):
    from .operators import search

    return search.document_search(w.pages(s, d), own_document(s, d), vector(s, d), 3, -0.2)


query("page_context", f"{FOUND} {CONTEXT}")(lambda s, d: rag.context(found(s, d)))
_lines = " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in rag.GROUNDED.replace("%s", "\0", 1).replace("%s", "\1").split("\n")).replace("\0", "T").replace("\1", "' || context || '")
query("system_prompt", f"{FOUND} SELECT {_lines} AS prompt FROM ({CONTEXT})")(lambda s, d: rag.context(found(s, d)).select(rag.system_prompt(F.lit("T"), C("context")).alias("prompt")))


QUESTION = "CASE WHEN conv_id % 7 = 0 THEN '  ' ELSE ' what is ' || conv_id || '? ' END"


@query(
    "rag_answer",
    f"{FOUND}, c AS ({CONTEXT}), past AS (SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn) AS past FROM ({LAST.format(8)}) GROUP BY 1) "
    f"SELECT (SELECT source || '-' || lang FROM documents WHERE doc_id = {QUERY_VECTOR}) AS document_id, conv_id, trim({QUESTION}) || ' after ' || md5(past) AS answer FROM past, c WHERE trim({QUESTION}) <> ''",
)
def _(s, d):
    """A question in every conversation, each with its own history; the model repeats the question and a digest of the history."""
    import hashlib

    doc, p = docs_pages(s, d)
    past = rag.history(w.table(s, d, "conversations"))
    asked = rag.ask_each(past.select("conv_id", F.expr(QUESTION).alias("question")), p, doc, own_document(s, d), vector(s, d), past, 3, -0.2)

    def model(messages):
        old = "|".join(f"{m['role']}:{m['content']}" for m in messages[1:-1])
        return f"```\n{messages[-1]['content']} after {hashlib.md5(old.encode()).hexdigest()}\n```"

    return rag.answered(asked, model)


_many = f"""asked AS (SELECT conv_id, source || '-' || lang AS document_id, {{}} AS question, e.embedding AS v FROM (SELECT DISTINCT conv_id FROM conversations) JOIN documents ON doc_id = conv_id % 200 JOIN embeddings e ON vec_id = conv_id * 3 % 400),
f AS (SELECT * FROM (SELECT conv_id, page_id, page_number, original_markdown, translated_markdown, similarity, row_number() OVER (PARTITION BY conv_id ORDER BY similarity DESC, page_id) AS n FROM (
  SELECT conv_id, page_id, page_number, original_markdown, translated_markdown, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 9) AS similarity FROM asked JOIN w_pages USING (document_id) WHERE extraction_status = 'completed' AND embedding IS NOT NULL) WHERE similarity >= -0.05) WHERE n <= 3)"""


@query(
    "rag_ask_many",
    f"{w.ONLY_PAGES}, {_many.format(QUESTION)}, c AS (SELECT conv_id, {CONTEXT.removeprefix('SELECT ').removesuffix(' FROM f')} FROM f GROUP BY conv_id), past AS (SELECT conv_id, count(*) AS n FROM ({LAST.format(8)}) GROUP BY 1) "
    f"SELECT conv_id, document_id, md5(coalesce(context, '')) AS context, n + 2 AS n_messages FROM asked LEFT JOIN c USING (conv_id) JOIN past USING (conv_id) WHERE trim(question) <> ''",
)
def _(s, d):
    """Every conversation asks about its own document with its own vector."""
    doc, p = docs_pages(s, d)
    past = rag.history(w.table(s, d, "conversations"))
    about = w.table(s, d, "documents").select(C("doc_id").alias("_d"), F.concat_ws("-", "source", "lang").alias("document_id"))
    with_vector = w.table(s, d, "embeddings").select(C("vec_id").alias("_v"), C("embedding").alias("vector"))
    asked = past.select("conv_id", F.expr(QUESTION).alias("question")).join(about, C("conv_id") % 200 == C("_d")).join(with_vector, C("conv_id") * 3 % 400 == C("_v"))
    found = rag.ask_many(asked, p, doc, past, 3, -0.05)
    return found.select("conv_id", "document_id", F.md5(C("context").cast("binary")).alias("context"), F.size("messages").cast("long").alias("n_messages"))
