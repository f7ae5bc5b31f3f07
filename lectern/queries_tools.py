"""The inventory, continued: sources, injected tools and models (with deterministic stand-ins), ingest and health."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import queries_rules, workload as w  # noqa: F401  some names below are aliases of its queries
from .functions import labels, markdown
from .operators import health, ingest, ops, rag
from .operators.lifecycle import TRANSITIONS
from .plans.keep import shared_folder
from .queries import DIRS, ORACLES, QUERIES, C, docs_pages, length_of, length_vector, on_documents, on_inputs, on_table, query  # noqa: F401
from .sources import catalogues, files, models
from .streaming import run, stateful


def uploads(s, d):
    """Every text as an uploaded file; its lines stand for pages."""
    return w.table(s, d, "documents").selectExpr(
        "cast(doc_id AS string) AS document_id",
        "'my_' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.docx' WHEN 1 THEN '.png' ELSE '.pdf' END AS filename",
        "lang AS target_language",
        "cast(doc_id AS string) AS path",
        "cast(text AS binary) AS content",
    )


def by_lines(raw: bytes):
    return iter(raw.split(b"\n"))


def shouted(raw: bytes) -> bytes:
    if len(raw) % 7 == 0:
        raise ValueError("unreadable")
    return raw.upper()


LINES = "SELECT doc_id::VARCHAR AS path, unnest(range(1, len(ls) + 1))::INT AS page_number, ls[unnest(range(1, len(ls) + 1))] AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"
query("pdf_extract_pages", f"SELECT path, page_number, strlen(t) AS bytes FROM ({LINES})")(lambda s, d: files.extracted(uploads(s, d), by_lines).select("path", "page_number", F.octet_length("content").cast("long").alias("bytes")))
query("pdf_extract_page", f"SELECT path, page_number, strlen(t) AS bytes FROM ({LINES}) WHERE page_number = 2")(lambda s, d: files.extracted(uploads(s, d), by_lines, 2).select("path", "page_number", F.octet_length("content").cast("long").alias("bytes")))
query("doc_convert", "SELECT doc_id::VARCHAR AS path, CASE WHEN strlen(text) % 7 <> 0 THEN strlen(text) END AS bytes, CASE WHEN strlen(text) % 7 = 0 THEN 'ValueError: unreadable' END AS error FROM documents")(
    lambda s, d: files.converted(uploads(s, d), shouted).select("path", F.octet_length("content").cast("long").alias("bytes"), "error")
)
query("http_generate", "SELECT doc_id, length(text) || ':' || text || 'x' AS value, NULL::VARCHAR AS error FROM documents")(
    lambda s, d: models.generated(w.table(s, d, "documents").select("doc_id", "text"), "doc_id", "text", lambda p: f"```md\n{len(p)}:{p}x\n```", attempts=1)
)
query("http_embed", "SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN length(text)::VARCHAR END AS value, NULL::VARCHAR AS error FROM documents")(
    lambda s, d: models.embedded(w.table(s, d, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 9 <> 0 THEN text END AS t"), "doc_id", "t", length_vector).select("doc_id", length_of(C("value")).cast("string").alias("value"), "error")
)


@query("http_chat", "SELECT conv_id::VARCHAR AS document_id, 'q' || conv_id AS answer FROM conversations GROUP BY conv_id")
def _(s, d):
    past = rag.history(w.table(s, d, "conversations"))
    asked = past.select(C("conv_id").cast("string").alias("document_id"), rag.build_messages(F.lit("sys"), C("history"), F.concat(F.lit("q"), C("conv_id").cast("string"))).alias("messages"))
    return rag.answered(asked, lambda messages: messages[-1]["content"])


@query("locate_source_file", "SELECT doc_id::VARCHAR AS document_id, '/u/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '/original.docx' WHEN 1 THEN '/original.pdf' ELSE '/original.odt' END AS path FROM documents")
def _(s, d):
    listed = w.table(s, d, "documents").selectExpr("cast(doc_id AS string) AS document_id", "doc_id", "explode(array(CASE doc_id % 3 WHEN 0 THEN 'original.docx' WHEN 1 THEN 'original.pdf' ELSE 'page-1.png' END, 'original.odt')) AS name")
    return files.source_file(listed.selectExpr("document_id", "'/u/' || doc_id || '/' || name AS path"))


@query("ingest_document", "SELECT doc_id::VARCHAR AS document_id, CASE doc_id % 5 WHEN 1 THEN 'error' ELSE 'completed' END AS status, CASE WHEN doc_id % 5 <> 1 THEN len(string_split(text, chr(10)))::INT END AS total_pages FROM documents")
def _(s, d):
    return ingest.ingest(uploads(s, d), by_lines, lambda image: image, lambda t: t.upper(), lambda t: [1.0], lambda raw: raw, attempts=1)[0].select("document_id", "status", "total_pages")


on_inputs("translate_prompt", lambda i: i.select("id", rag.translate_prompt(labels.prompt_language(C("lang")), C("text")).alias("prompt")), "SELECT id, 'Translate the Markdown into ' || CASE lang WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE lang END || '. Keep its structure; return the translation alone.' || chr(10) || chr(10) || text AS prompt FROM w_inputs")
on_table("markdown_to_html", "documents", lambda t: t.select("doc_id", markdown.rendered("text").alias("html")), None)
on_table("uuid_v7", "events", lambda t: t.select("event_id", markdown.uuid7_column(C("ts").cast("timestamp"), C("event_id")).alias("id")).select("event_id", F.substring("id", 1, 15).alias("prefix"), F.length("id").cast("long").alias("n")).select("event_id", F.substring("prefix", 15, 1).alias("version"), F.conv(F.concat(F.substring("prefix", 1, 8), F.substring("prefix", 10, 4)), 16, 10).cast("long").alias("ms"), "n"), "SELECT event_id, '7' AS version, floor(epoch_us(ts) / 1000)::BIGINT AS ms, 36::BIGINT AS n FROM events")
query("health_checks", "SELECT * FROM (VALUES ('session', 'ok', NULL), ('tables', 'ok', NULL), ('broken', 'error', 'no answer'), ('cut', 'error', 'circuit_open')) t(\"check\", result, error)")(
    lambda s, d: health.run_checks(s, {"session": lambda: health.check_session(s), "tables": lambda: None if w.table(s, d, "region").count() else "empty", "broken": lambda: "no answer", "cut": lambda: None}, frozenset({"cut"})).select("check", "result", "error")
)
TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier"
query("dir_scan", "SELECT * FROM (VALUES " + ", ".join(f"('{t}.parquet', false)" for t in TABLES.split()) + ") t(name, is_dir)")(lambda s, d: files.as_tables(s, d, files.listing(s, d)).select("name", "is_dir"))


@query("file_mtime_scan", f"SELECT name, mtime::VARCHAR AS mtime FROM ({DIRS.format('to_hours(doc_id % 100)', 'documents')}) WHERE is_dir AND mtime < TIMESTAMP '2024-01-13 00:00:00' - INTERVAL 30 HOURS")
def _(s, d):
    """Directories that were last changed more than 30 hours ago."""
    listed = s.sql(DIRS.format("make_dt_interval(0, cast(doc_id % 100 as int))", "{t}").replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), t=w.table(s, d, "documents"))
    return files.older_than(listed, 30, F.expr("timestamp_ntz'2024-01-13 00:00:00'")).select("name", C("mtime").cast("string").alias("mtime"))


@query("sweep_delete", "SELECT 2::BIGINT AS counted, 3::BIGINT AS still_there, 2::BIGINT AS deleted, 1::BIGINT AS left_over")
def _(s, d):
    """Two of three directories belong to no document: a dry run counts them, a sweep deletes them."""
    root = f"{shared_folder(s)}/sweep-{uuid.uuid4().hex}"
    path = s.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    try:
        for name in ("src1-en", "gone-1", "gone-2"):
            fs.create(path(f"{root}/{name}/original.pdf")).close()
        later = F.current_timestamp() + F.expr("INTERVAL 48 HOURS")
        lost = ops.orphans(files.listing(s, root), w.documents(s, d), later)
        counted, there = files.sweep(s, root, lost, dry_run=True), files.listing(s, root).count()
        return s.createDataFrame([(counted, there, files.sweep(s, root, lost), files.listing(s, root).count())], "counted long, still_there long, deleted long, left_over long")
    finally:
        fs.delete(path(root), True)


CATALOGUE = """msgid ""
msgstr "Language: de\\n"

# a remark
msgid "page"
msgid_plural "pages"
msgstr[0] "Seite"
msgstr[1] ""
"Seiten"

msgid "say \\"hi\\""
msgstr "sag\\n"
"hallo"

#~ msgid "old"
#~ msgstr "alt"
"""


@query("po_source", "SELECT * FROM (VALUES ('de', 'errors', '', 0, 'Language: de' || chr(10)), ('de', 'errors', 'page', 0, 'Seite'), ('de', 'errors', 'page', 1, 'Seiten'), ('de', 'errors', 'say \"hi\"', 0, 'sag' || chr(10) || 'hallo')) t(lang, domain, msgid, plural, msgstr)")
def _(s, d):
    """A catalogue with continued lines, plurals, escapes and remarks."""
    root = f"{shared_folder(s)}/catalogue-{uuid.uuid4().hex}"
    path = s.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/de/LC_MESSAGES/errors.po")
    out = path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(CATALOGUE.encode()))
    out.close()
    return catalogues.read(s, root).select("lang", "domain", "msgid", "plural", "msgstr")


query("http_list_models", "SELECT * FROM (VALUES ('big:7b'), ('small')) t(name)")(lambda s, d: s.createDataFrame([(n,) for n in models.model_names({"models": [{"name": "big:7b", "size": 1}, {"name": "small"}]})], "name string"))
on_inputs(
    "translate_error",
    lambda i: i.select("id", labels.error_message(F.lit("needs %{count} character (%{kind})"), F.lit("needs %{count} characters (%{kind}, %{odd})"), F.expr("CASE WHEN id % 4 <> 0 THEN id % 4 END"), kind=C("language")).alias("message")),
    "SELECT id, CASE WHEN coalesce(id % 4, 0) IN (0, 1) THEN 'needs ' || CASE WHEN id % 4 = 0 THEN '%{count}' ELSE '1' END || ' character (' || coalesce(language, '%{kind}') || ')' ELSE 'needs ' || id % 4 || ' characters (' || coalesce(language, '%{kind}') || ', %{odd})' END AS message FROM w_inputs",
)
query("extraction_prompt", "SELECT 'Transcribe the page image to Markdown. Keep headings, lists and tables; add nothing.' || chr(10) AS prompt")(lambda s, d: s.range(1).select(F.lit(rag.EXTRACT).alias("prompt")))
for alias, name in {"status_text": "status_color", "permanent": "retryable", "language_name": "language_name_ui"}.items():
    QUERIES[alias], ORACLES[alias] = QUERIES[name], ORACLES[name]


# --- streams, run to the end of their source ----------------------------------------------------------------------------


@query("topic_broadcast_stream", "SELECT event_id, topic FROM (SELECT event_id, unnest(['document:' || user_id, 'documents']) AS topic FROM events)")
def _(s, d):
    updates = run.table_stream(s, f"{d}/events.parquet").select("event_id", C("user_id").cast("string").alias("document_id"))
    return run.drained(stateful.broadcasts(updates).select("event_id", "topic"))


@query("viewer_refresh", "SELECT event_id FROM events WHERE user_id = 7")
def _(s, d):
    return run.drained(stateful.viewed(run.table_stream(s, f"{d}/events.parquet").select("event_id", C("user_id").alias("page_id")), 7).select("event_id"))


@query("dashboard_refresh", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    """The whole view is recomputed for each micro-batch; what is left is the view after the last one."""
    shown = {}
    events = run.table_stream(s, f"{d}/events.parquet")
    view = lambda: w.table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    stateful.refreshed(events, view, lambda df, epoch: shown.update(last=df)).trigger(availableNow=True).start().awaitTermination()
    return shown.get("last", view())


@query("circuit_breaker_stream", f"WITH RECURSIVE {queries_rules.OPENINGS} SELECT fuse, make_timestamp(opened)::VARCHAR AS ts, 'blown' AS state FROM o")
def _(s, d):
    """When breakers by event type open. That one closes after its pause depends on what comes later, so tests hold it against the plain rule."""
    events = run.table_stream(s, f"{d}/events.parquet").select(C("event_type").alias("fuse"), C("ts").cast("timestamp").alias("ts"), (C("value") > 60).alias("failed"))
    return run.drained(stateful.breakers(events, 3, 14_400, 1_800)).filter("state = 'blown'").withColumn("ts", C("ts").cast("string"))


_steps = {"status": [], "result": [], "error": []}
for _name, (_valid, _to, _said, _errors) in TRANSITIONS.items():
    _may = "status NOT IN (" + ", ".join(f"'{x}'" for x in _errors) + ")" if _valid is None else "status IN (" + ", ".join(f"'{x}'" for x in sorted(_valid)) + ")"
    _steps["status"].append(f"WHEN event = '{_name}' AND {_may} THEN '{_to}'")
    _steps["result"].append(f"WHEN event = '{_name}' AND {_may} THEN '{_said}'")
    _steps["error"] += [f"WHEN event = '{_name}' AND status = '{k}' THEN '{v}'" for k, v in _errors.items()] + [f"WHEN event = '{_name}' AND NOT ({_may}) THEN 'invalid_status'"]
NAMES = "[" + ", ".join(f"'{x}'" for x in TRANSITIONS) + f"][1 + event_id % {len(TRANSITIONS)}]"


@query(
    "document_fsm_stream",
    f"""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS document_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_type = 'signup' THEN 'create' ELSE {NAMES} END AS event FROM events),
s AS (SELECT document_id, NULL::BIGINT AS seq, 0::BIGINT AS n, NULL::VARCHAR AS event, NULL::VARCHAR AS status, NULL::VARCHAR AS result, NULL::VARCHAR AS error FROM e GROUP BY 1
  UNION ALL
  SELECT e.document_id, e.seq, e.n, e.event, CASE WHEN e.event = 'create' THEN 'queued' ELSE (CASE {' '.join(x.replace("event =", "e.event =") for x in _steps['status'])} ELSE status END) END,
    CASE WHEN e.event = 'create' THEN 'created' ELSE (CASE {' '.join(x.replace("event =", "e.event =") for x in _steps['result'])} END) END,
    CASE WHEN e.event = 'create' THEN NULL WHEN status IS NULL THEN 'document_not_found' ELSE (CASE {' '.join(x.replace("event =", "e.event =") for x in _steps['error'])} END) END
  FROM s JOIN e ON e.document_id = s.document_id AND e.n = s.n + 1)
SELECT document_id, seq, event, status, result, error FROM s WHERE n > 0""",
)
def _(s, d):
    """Life cycles of documents under a stream of events."""
    events = run.table_stream(s, f"{d}/events.parquet")
    name = F.element_at(F.array(*(F.lit(e) for e in TRANSITIONS)), (C("event_id") % len(TRANSITIONS) + 1).cast("int"))
    return run.drained(stateful.life_cycles(events.select(C("user_id").cast("string").alias("document_id"), C("event_id").alias("seq"), F.when(C("event_type") == "signup", "create").otherwise(name).alias("event"), F.lit("queued").alias("status"))))
