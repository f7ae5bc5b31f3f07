"""Rules that were once read wrongly, and state machines against their definitions."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import labels, markdown
from lectern.operators import corpus, health, ingest, lifecycle, logs, ops, rag
from lectern.sources import catalogues, models


def test_a_full_queue_refuses_high_jobs_too(spark):
    rows = [(k, "normal", "a") for k in range(10)] + [(10, "high", "a"), (11, "normal", "a"), (3, "high", "b"), (4, "normal", "b"), (5, "high", "b")]
    jobs = spark.createDataFrame(rows, "seq long, priority string, name string")
    got = {(r.name, r.seq): r.place for r in lifecycle.queued(jobs, 10, "name").collect()}
    assert got == {**{("a", k): k + 1 for k in range(10)}, ("a", 10): None, ("a", 11): None, ("b", 5): 1, ("b", 3): 2, ("b", 4): 3}
    one = lifecycle.queued(jobs.filter("name = 'a'"), 10)
    assert {r.seq: (r.place, r.accepted) for r in one.collect()} == {k: (k + 1, True) if k < 10 else (None, False) for k in range(12)}
    assert "SinglePartition" not in one._jdf.queryExecution().executedPlan().toString() or "TakeOrdered" in one._jdf.queryExecution().executedPlan().toString()


def test_an_update_writes_nulls_and_repeats_no_rows(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", None)], "id int, name string, note string")
    changes = spark.createDataFrame([(1, None, 1), (1, "late", 2), (2, None, 1), (9, "z", 1)], "id int, note string, seq int")
    assert sorted(tuple(r) for r in corpus.updated(table, changes, "id", "seq").collect()) == [(1, "a", "late"), (2, "b", None), (3, "c", None)]
    assert sorted(tuple(r) for r in corpus.updated(table, changes.drop("seq"), "id").collect()) == [(1, "a", "late"), (2, "b", None), (3, "c", None)]


def test_new_pages_follow_their_numbers(spark):
    images = spark.createDataFrame([(2, "b"), (1, "a")], "page_number int, image_path string")
    pages = spark.createDataFrame([], "page_id long, document_id string, page_number int, image_path string, extraction_status string, translation_status string, embedding_status string")
    made = corpus.bulk_pages(pages, "d", images, 100)
    assert sorted((r.page_id, r.page_number) for r in made.collect()) == [(100, 1), (101, 2)]
    assert "Window" not in made._jdf.queryExecution().executedPlan().toString()


def test_percentiles_come_from_a_sketch(spark):
    out = ops.summary(spark.range(1, 101).selectExpr("double(id) v", "'t' tag"), "v", "tag")
    r = out.first()
    assert (r.median, r.p95) == (50.0, 95.0) and "percentile_approx" in out._jdf.queryExecution().executedPlan().toString()


def test_escapes_are_undone_one_kind_after_the_other(spark):
    for raw in (r"a\\n", r"\"x\\", r"\n\\\"", "plain"):
        column = spark.createDataFrame([(raw,)], "t string").select(labels.po_unescaped(F.col("t"))).first()[0]
        assert catalogues.unescape(raw) == column
    assert catalogues.unescape(r"a\\n") == "a\\\n"


def test_deep_quotes_and_nested_lists():
    deep = markdown.to_html(">" * 3000 + " x")
    assert deep.startswith("<blockquote>" * 50) and "x" in deep and deep.count("<blockquote>") == deep.count("</blockquote>")
    assert markdown.to_html("- a\n  - b\n    1. c\n- d") == "<ul><li>a<ul><li>b<ol><li>c</li></ol></li></ul></li><li>d</li></ul>"
    assert markdown.to_html("- a\n1. b") == "<ul><li>a</li></ul><ol><li>b</li></ol>"
    assert markdown.to_html("> a\n> > b\n\nc") == "<blockquote><p>a</p><blockquote><p>b</p></blockquote></blockquote><p>c</p>"


def test_one_bad_text_fails_no_other(spark, monkeypatch):
    df = spark.createDataFrame([("> " * 5000 + "x",), ("**y**",), (None,)], "t string")
    got = [r.h for r in df.select(markdown.rendered("t").alias("h")).collect()]
    assert "x" in got[0] and got[1:] == ["<p><strong>y</strong></p>", ""]


def test_every_foreign_call_is_made_once(spark, tmp_path):
    """Calls are counted as files; both results are collected once."""
    import uuid

    def count(kind):
        (tmp_path / f"{kind}-{uuid.uuid4().hex}").touch()

    def extract(raw):
        count("extract")
        return iter(raw.split(b"|"))

    def said(kind, value):
        def call(x):
            count(kind)
            return value(x)

        return call

    uploads = spark.createDataFrame([("d1", "a.pdf", "en", "p1", b"one|two"), ("d2", "b.docx", "de", "p2", b"x")], "document_id string, filename string, target_language string, path string, content binary")
    docs, pages = ingest.ingest(uploads, extract, said("read", lambda image: "text"), said("translate", str.upper), said("embed", lambda t: [1.0]), said("convert", lambda raw: raw))
    assert docs.count() == 2 and pages.count() == 3
    docs.collect(), pages.collect()
    kinds = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert {k: kinds.count(k) for k in set(kinds)} == {"extract": 2, "read": 3, "translate": 3, "embed": 3, "convert": 1}


def breaker(spark, rows, tolerated, seconds, refresh):
    calls = spark.createDataFrame([("f", at * 1_000_000, k, failed) for k, (at, failed) in enumerate(rows)], "fuse string, at long, id long, failed boolean")
    return [(r.outcome, r.opened) for r in logs.breaker_calls(calls, tolerated, seconds, refresh).orderBy("id").collect()]


def test_a_breaker_tolerates_five_and_opens_at_the_sixth(spark):
    got = breaker(spark, [(k, True) for k in range(6)] + [(6, False), (35, True), (36, False), (100, True)], 5, 60, 30)
    assert got[:5] == [("failed", False)] * 5 and got[5] == ("failed", True)
    assert got[6:8] == [("rejected", False), ("failed", False)] or got[6] == ("rejected", False)
    assert got[7] == ("failed", False) and got[8] == ("ok", False) and got[9] == ("failed", False)  # closed again 30 s after it opened, without failures


def test_failures_out_of_the_window_do_not_open(spark):
    assert not any(opened for _, opened in breaker(spark, [(k * 20, True) for k in range(12)], 5, 60, 30))


def test_queue_operations(spark):
    ops_ = [("next", None, False), ("add", 1, False), ("add", 2, False), ("add", 3, True), ("remove", 2, False), ("next", None, False), ("complete", 3, False), ("timeout", 9, False), ("clear", None, False), ("next", None, False), ("next", None, False)]
    log = spark.createDataFrame([("q", k, *x) for k, x in enumerate(ops_)], "queue string, seq long, op string, id long, high boolean")
    got = [(r.result, r.pending, r.completed, r.failed) for r in logs.queue_log(log, 10).orderBy("seq").collect()]
    assert got == [("empty", 0, 0, 0), ("ok", 1, 0, 0), ("ok", 2, 0, 0), ("ok", 3, 0, 0), ("ok", 2, 0, 0), ("3", 1, 0, 0), ("ok", 1, 1, 0), ("ok", 1, 1, 1), ("ok", 1, 0, 1), ("1", 0, 0, 1), ("empty", 0, 0, 1)]
    full = spark.createDataFrame([("q", k, "add", k, k == 2) for k in range(3)] + [(None, 9, "add", 1, False)], "queue string, seq long, op string, id long, high boolean")
    assert [r.result for r in logs.queue_log(full, 2).orderBy("seq").collect()] == ["ok", "ok", "queue_full"]


def test_one_question_at_a_time(spark):
    log = [("ask", 1, "a"), ("ask", 2, "b"), ("reply", 2, ""), ("reply", 1, ""), ("ask", 3, "  "), ("ask", 4, "c"), ("error", 4, ""), ("reply", 4, "")]
    df = spark.createDataFrame([("c", k, *x) for k, x in enumerate(log)], "conversation string, seq long, kind string, ref long, text string")
    assert [(r.outcome, r.history) for r in logs.chat_log(df).orderBy("seq").collect()] == [("asked", 0), ("ignored", 0), ("stale", 0), ("answered", 2), ("ignored", 2), ("asked", 2), ("failed", 2), ("stale", 2)]


def test_clock_fields():
    assert health.cron_field("*/20", 0, 59) == [0, 20, 40] and health.cron_field("1-3,7", 0, 9) == [1, 2, 3, 7] and health.cron_field("5/2", 0, 9) == [5, 7, 9]
    for bad in ("60", "5-1", "*/0"):
        with pytest.raises(ValueError, match="bad field"):
            health.cron_field(bad, 0, 59)


def test_queues_have_places(spark):
    rows = [(k, "llm_processing", "available", 0, 1) for k in range(3)] + [(10, "embedding_generation", "executing", 0, 1), *((k, "embedding_generation", "retryable", 1, 20 - k) for k in range(11, 17)), (20, "pdf_extraction", "available", 3, 1), (21, "no", "available", 0, 1), (22, "pdf_extraction", "completed", 0, 1)]
    got = {r.id: r.decision for r in health.assigned(spark.createDataFrame(rows, "id int, queue string, state string, attempt int, priority int")).collect()}
    assert got == {0: "run", 1: "wait", 2: "wait", 10: "goes_on", 11: "wait", 12: "wait", **{k: "run" for k in range(13, 17)}, 20: "discard", 21: "wait", 22: "none"}


def test_an_answer_uses_its_own_conversation(spark):
    docs = spark.createDataFrame([("d", "T", "en", "completed")], "document_id string, title string, target_language string, status string")
    pages = spark.createDataFrame([(1, "d", 1, None, "completed", "text", None, [1.0, 0.0])], "page_id long, document_id string, page_number int, image_path string, extraction_status string, original_markdown string, translated_markdown string, embedding array<float>")
    past = spark.createDataFrame([(1, [("user", "one")]), (2, [("user", "two")])], "conv_id long, history array<struct<role:string,content:string>>")
    for conversation, old in ((1, ["one"]), (2, ["two"]), (3, []), (None, [])):
        row = rag.ask(pages, docs, "d", " q ", [1.0, 0.0], past, conversation).first()
        assert [m["content"] for m in row.messages[1:]] == [*old, "q"] and "text" in row.context


def test_services_have_breakers_of_their_own():
    assert models.breaker_of("embedding_api").tolerated == 3 and models.breaker_of("model_api").tolerated == 5
    assert models.breaker_of("model_api") is models.breaker_of("model_api")
