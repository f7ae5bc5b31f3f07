import pytest
from pyspark.sql import functions as F

from lectern import schema
from lectern.functions import labels, markdown, resilience, sanitizing, validation
from lectern.operators import corpus, lifecycle, rag
from lectern.queries import QUERIES, C


def one(spark, column, **values):
    """The value of an expression over one row."""
    schema_ = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema_).select(column.alias("x")).first().x


def docs_pages(spark):
    docs = spark.createDataFrame([("a", "processing", 2), ("b", "completed", 1), ("c", "processing", None), ("d", "processing", 0)], "document_id string, status string, total_pages int")
    pages = spark.createDataFrame([("a", 1, 1, "completed", "completed"), ("a", 2, 2, "pending", "pending"), ("b", 3, 1, "completed", "completed"), ("c", 4, 1, "completed", "error")], "document_id string, page_id long, page_number int, extraction_status string, translation_status string")
    return docs, pages


def test_progress_and_completion(spark):
    docs, pages = docs_pages(spark)
    assert {r.document_id: r.progress for r in corpus.with_progress(docs, pages).collect()} == {"a": 50.0, "b": 100.0, "c": 0.0, "d": 0.0}
    assert {r.document_id: r.all_completed for r in corpus.completion(docs, pages).collect()} == {"a": False, "b": True, "c": False, "d": True}
    assert {r.document_id: r.status for r in lifecycle.completed_documents(docs, corpus.completion(docs, pages)).collect()}["d"] == "completed"


@pytest.mark.parametrize(("value", "error"), [("x" * 501, "Query too long (max 500 characters)"), ("", "Query too short (minimum 3 characters)"), ("a <script> b", "Query contains invalid characters"), (" fine ", None), (None, "Search query must be a string")])
def test_search_queries(spark, value, error):
    assert one(spark, validation.search_query_error(C("q")), q=value) == error


def test_names(spark):
    path = one(spark, sanitizing.filename_string(C("f")), f="../../../etc/passwd")
    assert ".." not in path and "/" not in path
    assert one(spark, sanitizing.filename_string(C("f")), f="test\0file.pdf") == "testfile.pdf"
    assert one(spark, sanitizing.filename(C("f")), f="..a  b??c.pdf.") == "_a_b_c.pdf"
    assert one(spark, validation.filename_error(C("f")), f="a\\b.pdf") is None
    assert one(spark, validation.filename_error(C("f")), f="a|b") == "Filename contains invalid characters"
    assert one(spark, labels.title_of(C("f")), f="dir/my_big-book.pdf") == "my big book"
    assert one(spark, labels.title_of(C("f")), f="a_b.docx") == "a b.docx"


def test_markup(spark):
    out = one(spark, sanitizing.markdown_string(C("m")), m="<script>alert('xss')</script># Heading <img src=x onerror=y>")
    assert out == "# Heading "
    assert one(spark, sanitizing.markdown_string(C("m")), m="<script>\nx</script>") == "\nx"  # the block rule stays on one line
    assert one(spark, sanitizing.markdown(C("m")), m='a data:image] javascript:x "data:b"') == 'a  x "data:b"'
    assert one(spark, sanitizing.code_fences(C("m")), m="```md\n# T\n```\n") == "# T"


@pytest.mark.parametrize(("attempt", "base", "most", "ms"), [(0, 1000, 30000, 1000), (1, 1000, 30000, 2000), (2, 1000, 30000, 4000), (3, 1000, 30000, 8000), (10, 1000, 5000, 5000)])
def test_backoff(spark, attempt, base, most, ms):
    assert one(spark, resilience.backoff(C("n"), base, most, jitter=0), n=attempt) == ms
    assert abs(one(spark, resilience.backoff(C("n"), base, most, seed=C("n")), n=attempt) - ms) <= ms / 4


@pytest.mark.parametrize(("text", "kind"), [("connection timeout", "retryable"), ("HTTP 500 error", "retryable"), ("rate limit exceeded", "retryable"), ("file not found", "permanent"), ("model x is not here", "permanent"), ("odd", "unknown"), ("404 timeout", "retryable"), ("Timeout", "unknown")])
def test_error_classes(spark, text, kind):
    assert one(spark, resilience.error_class(C("m")), m=text) == kind


def test_transitions(spark):
    step = lambda status, event: tuple(one(spark, lifecycle.transition(C("s"), C("e")), s=status, e=event))
    assert step("queued", "start") == ("processing", "processing_started", None)
    assert step("processing", "start") == ("processing", None, "already_processing")
    assert step("error", "start") == ("error", None, "invalid_status")
    assert step("completed", "reset") == ("completed", None, "cannot_reset_completed")
    assert step("error", "reset") == ("queued", "reset", None)
    assert step("processing", "fail") == ("error", "failed", None)
    assert step(None, "start") == (None, None, "document_not_found")


def test_breaker_tolerates_its_number(spark):
    rows = [("f", k) for k in range(6)] + [("g", k * 100) for k in range(6)]
    events = spark.createDataFrame(rows, "fuse string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.fuse, r.s): r.open for r in lifecycle.breaker_opens(events, 5, 60).collect()}
    assert [got["f", k] for k in range(6)] == [False] * 5 + [True] and not any(got["g", k * 100] for k in range(6))


def test_locale_paging_and_labels(spark):
    assert one(spark, labels.accept_language(C("h")), h="xx, pt-BR;q=0.9, en") == "pt"
    assert one(spark, labels.accept_language(C("h")), h="xx") == "en"
    assert [one(spark, labels.page_number_of(C("p")), p=p) for p in ("3", "x", "-1", "0", None)] == [3, 1, 1, 1, 1]
    assert one(spark, labels.fts_config(C("l")), l="pl") == "simple"
    assert one(spark, labels.prompt_language(C("l")), l="da") == "da" and one(spark, labels.language_name(C("l")), l="da") == "Danish"
    assert one(spark, labels.status_text(C("s")), s="extracting") == "Processing"
    assert one(spark, labels.back_url(C("o"), C("q"), C("p")), o="search", q="a b", p="2") == "/search?q=a+b&page=2"


def test_context_prefers_translations_and_skips_empty_pages(spark):
    found = spark.createDataFrame([(1, 4, "o", " t ", 0.9), (2, 2, "orig", None, 0.95), (3, 7, "o", "", 0.99), (4, 1, None, None, 0.5)], "page_id long, page_number int, original_markdown string, translated_markdown string, similarity double")
    assert rag.context(found).first().context == "[Page 2]\norig\n\n---\n\n[Page 4]\nt"
    assert rag.context(found.limit(0)).first().context == ""


def test_messages_keep_the_last_eight(spark):
    past = spark.createDataFrame([(1, k, "user", f"m{k}") for k in range(20)], "conv_id long, turn long, role string, text string")
    row = rag.history(past, 16).select(rag.build_messages(F.lit("s"), C("history"), F.lit("q")).alias("m")).first()
    assert [m.content for m in row.m] == ["s", *(f"m{k}" for k in range(12, 20)), "q"]
    with pytest.raises(ValueError, match="empty_question"):
        rag.ask(None, None, "d", "  ", [1.0])


def test_constraints(spark):
    docs = spark.createDataFrame([("a", "odd"), ("a", "queued")], "id string, status string")
    pages = spark.createDataFrame([("p", "x", 1, "pending", "pending", "pending", [1.0]), ("q", "x", 1, "failed", "pending", "pending", None)], "id string, document_id string, page_number int, extraction_status string, translation_status string, embedding_status string, embedding array<float>")
    got = {r.rule: r.n for r in schema.violations(docs, pages).collect()}
    assert got == {"status of documents": 1, "extraction_status of pages": 1, "documents.id is unique": 1, "one page of a number in a document": 1, "every page has a document": 2, "length of embedding": 1}


def test_markdown(spark):
    html = markdown.to_html("# T\n\n**b** *i* `c<d` [l](http://x) [j](javascript:y)\n\n- a\n- b\n\n1. x\n\n```\n<s>\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n> q")
    assert "<h1>T</h1>" in html and "<strong>b</strong> <em>i</em> <code>c&lt;d</code>" in html and 'href="http://x"' in html and "javascript" not in html
    assert "<ul><li>a</li><li>b</li></ul><ol><li>x</li></ol>" in html and "<pre><code>&lt;s&gt;</code></pre>" in html and "<td>2</td>" in html and "<blockquote><p>q</p></blockquote>" in html
    assert markdown.to_html(None) == markdown.to_html("") == ""
    assert markdown.sanitized('<p onclick="x">a<script>b</script><a href="javascript:x" title="t">c</a><iframe>d') == '<p>a<a title="t">c</a>d'
    df = spark.createDataFrame([("**x**",), (None,)], "t string")
    assert [r.h for r in df.select(markdown.rendered("t").alias("h")).collect()] == ["<p><strong>x</strong></p>", ""]


def test_ids_sort_by_time(spark):
    ids = [markdown.uuid7(ms, str(k)) for k, ms in enumerate((1, 2, 1_700_000_000_000, 1_700_000_000_001))]
    assert ids == sorted(ids) and all(x[14] == "7" and x[19] in "89ab" and len(x) == 36 for x in ids)
    df = spark.range(50).select(markdown.uuid7_column(F.timestamp_millis(C("id") + 1_700_000_000_000), C("id")).alias("u"), "id").orderBy("id")
    got = [r.u for r in df.collect()]
    assert got == sorted(got) and len(set(got)) == 50 and all(x[14] == "7" and x[19] in "89ab" and len(x) == 36 for x in got)
    assert markdown.message("%{count} file", {"count": 3}, "%{count} files") == "3 files" and markdown.message("%{a} %{b}", {"a": 1}) == "1 %{b}"


def test_lang_cross_takes_every_language(spark, tmp_path):
    docs = spark.range(130).selectExpr("id AS doc_id", "'l' || id AS lang", "'src' || id % 2 AS source")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["lang_cross"](spark, str(tmp_path)).collect()
    assert len({r.lang for r in got}) == 130 and len(got) == 260
