import os
import time

import pytest
from pyspark.sql import functions as F

from lectern.operators import health, ingest, ops
from lectern.sources import catalogues, files, models

PO = r"""
# comment
msgid ""
msgstr "Header: x\n"

msgid "One"
msgstr "Eins"

msgid "Long "
"line"
msgstr ""

msgid "%{count} file"
msgid_plural "%{count} files"
msgstr[0] "Datei \"x\""
msgstr[1] "Dateien\\"
#~ msgid "old"
#~ msgstr "alt"
"""


def test_catalogues(spark, tmp_path):
    for path, text in (("gettext/default.pot", PO.replace("Eins", "").replace("Datei", "")), ("gettext/de/LC_MESSAGES/default.po", PO)):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    rows = catalogues.read(spark, str(tmp_path)).cache()
    de = {(r.msgid, r.plural): r.msgstr for r in rows.filter("lang = 'de'").collect()}
    assert de == {("", 0): "Header: x\n", ("One", 0): "Eins", ("Long line", 0): "", ("%{count} file", 0): 'Datei "x"', ("%{count} file", 1): "Dateien\\"}
    missing = ops.missing_translations(rows.filter("lang IS NULL").select("domain", "msgid").distinct(), rows.filter("lang IS NOT NULL"), spark.createDataFrame([("de",), ("fr",), ("en",)], "lang string"))
    assert sorted((r.lang, r.msgid) for r in missing.collect()) == [("de", "Long line"), ("fr", "%{count} file"), ("fr", "Long line"), ("fr", "One")]
    total = {(r.lang, r.domain): r.n for r in ops.missing_counts(missing).collect()}
    assert total[None, None] == 4 and total["fr", None] == 3


def test_sweep(spark, tmp_path):
    from pyspark.sql import functions as F

    for name, age in (("kept", 100), ("old", 100), ("new", 1)):
        (tmp_path / name).mkdir()
        os.utime(tmp_path / name, (time.time() - age * 3600,) * 2)
    (tmp_path / "file").write_text("x")
    listed = files.listing(spark, str(tmp_path))
    docs = spark.createDataFrame([("kept",)], "document_id string")
    found = ops.orphans(listed, docs, F.current_timestamp(), 24)
    assert [r.name for r in found.collect()] == ["old"]
    assert files.sweep(spark, str(tmp_path), found, dry_run=True) == 1 and (tmp_path / "old").exists()
    assert files.sweep(spark, str(tmp_path), found) == 1 and not (tmp_path / "old").exists() and (tmp_path / "new").exists()
    assert files.listing(spark, str(tmp_path / "none")).count() == 0


def test_stored_tables_are_entries_and_no_directories(spark, tmp_path):
    from lectern.queries_tools import QUERIES

    spark.range(10).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(4).withColumn("k", F.col("id") % 2).write.partitionBy("k").parquet(str(tmp_path / "parts.parquet"))
    (tmp_path / "one.parquet").write_text("x")
    for name in ("uploads", "empty.parquet", "mixed.parquet"):
        (tmp_path / name).mkdir()
    (tmp_path / "mixed.parquet" / "original.pdf").write_text("x")
    directories = {r.name for r in files.listing(spark, str(tmp_path)).filter("is_dir").collect()}
    assert directories == {"many.parquet", "parts.parquet", "uploads", "empty.parquet", "mixed.parquet"}
    assert {r.name: r.is_dir for r in QUERIES["dir_scan"](spark, str(tmp_path)).collect()} == {"many.parquet": False, "parts.parquet": False, "one.parquet": False, "uploads": True, "empty.parquet": True, "mixed.parquet": True}


def test_images_and_source_files(spark, tmp_path):
    for name in ("page-10.png", "page-002.png", "page-x.png", "original.docx"):
        (tmp_path / name).write_bytes(b"\x89PNG" + name.encode())
    shown = files.images(files.binary_files(spark, str(tmp_path), encoded=True)).collect()
    assert [r.page_number for r in shown] == [2, 10] and shown[0].base64 == "iVBOR3BhZ2UtMDAyLnBuZw=="
    listed = spark.createDataFrame([("a", "/u/a/original.docx"), ("a", "/u/a/original.pdf"), ("b", "/u/b/original.odt"), ("b", "/u/b/page-1.png")], "document_id string, path string")
    assert {r.document_id: r.path for r in files.source_file(listed).collect()} == {"a": "/u/a/original.pdf", "b": "/u/b/original.odt"}


def test_injected_tools(spark):
    uploads = spark.createDataFrame([("p1", b"a|b|c"), ("p2", b"")], "path string, content binary")
    pages = files.extracted(uploads, lambda raw: iter(raw.split(b"|")))
    assert sorted((r.path, r.page_number, bytes(r.content)) for r in pages.collect()) == [("p1", 1, b"a"), ("p1", 2, b"b"), ("p1", 3, b"c"), ("p2", 1, b"")]
    assert files.extracted(uploads, lambda raw: iter(raw.split(b"|")), 2).count() == 1

    def convert(raw):
        if not raw:
            raise ValueError("empty")
        return raw.upper()

    done = {r.path: (r.content and bytes(r.content), r.error) for r in files.converted(uploads, convert).collect()}
    assert done == {"p1": (b"A|B|C", None), "p2": (None, "ValueError: empty")}


def test_models(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "")], "id long, t string")
    got = {r.id: r.value for r in models.embedded(df, "id", "t", lambda t: [1.0, len(t)]).collect()}
    assert got == {1: [1.0, 1.0], 2: None, 3: None}
    texts = {r.id: (r.value, r.error) for r in models.generated(df.fillna(""), "id", "t", lambda p: f"```\n{p}\n```", attempts=1).collect()}
    assert texts == {1: ("x", None), 2: (None, "empty response"), 3: (None, "empty response")}
    assert models.model_names({"models": [{"name": "a"}]}) == ["a"] and models.model_names({}) == []
    assert models.allowed(["a", None], ["a"]) and not models.allowed(["a", "b"], ["a"])
    assert models.chat([{"role": "user", "content": "hi"}], lambda m: " " + m[-1]["content"]) == "hi"


def test_retries_and_breaker():
    now, waits, calls = [0.0], [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise models.ModelError("timeout")
        return "ok"

    assert models.called(flaky, sleep=waits.append) == "ok" and waits == [2.0, 4.0]

    def wrong():
        raise models.ModelError("bad", permanent=True)

    with pytest.raises(models.ModelError, match="bad"):
        models.called(wrong, sleep=waits.append)
    assert len(waits) == 2
    breaker = models.Breaker(clock=lambda: now[0])
    for k in range(6):
        assert not breaker.is_open()
        breaker.melt()
    assert breaker.is_open()
    with pytest.raises(models.ModelError, match="circuit_open"):
        models.called(lambda: 1, breaker=breaker)
    now[0] = 31
    assert not breaker.is_open()


def test_ingest_leaves_the_states_of_each_page(spark):
    uploads = spark.createDataFrame(
        [("d1", "my_book.pdf", "en", "p1", b"one|two"), ("d2", "b.docx", "de", "p2", b"x"), ("d3", "c.png", "en", "p3", b"y"), ("d4", "bad.odt", "en", "p4", b"")],
        "document_id string, filename string, target_language string, path string, content binary",
    )

    def read(image):
        import base64

        raw = base64.b64decode(image).decode()
        if raw == "two":
            raise models.ModelError("unreadable", permanent=True)
        return f"# {raw}"

    def convert(raw):
        if not raw:
            raise ValueError("empty")
        return b"converted"

    docs, pages = ingest.ingest(uploads, lambda raw: iter(raw.split(b"|")), read, lambda t: t.upper(), lambda t: [1.0], convert)
    got = {r.page_id: (r.extraction_status, r.translation_status, r.embedding_status, r.translated_markdown) for r in pages.collect()}
    assert got == {"d1/1": ("completed", "completed", "completed", "# ONE"), "d1/2": ("error", "pending", "pending", None), "d2/1": ("completed", "completed", "completed", "# CONVERTED")}
    states = {r.document_id: (r.status, r.total_pages, r.title) for r in docs.collect()}
    assert states == {"d1": ("completed", 2, "my book"), "d2": ("completed", 1, "b.docx"), "d3": ("error", None, "c.png"), "d4": ("error", None, "bad.odt")}


def test_health(spark, tmp_path):
    checks = {"session": lambda: health.check_session(spark), "disk": lambda: health.check_writable(spark, str(tmp_path)), "none": lambda: health.check_writable(spark, str(tmp_path / "no")), "model": lambda: 1 / 0, "cut": lambda: None}
    got = {r.check: (r.result, r.error) for r in health.run_checks(spark, checks, frozenset({"cut"})).collect()}
    assert got["session"] == got["disk"] == ("ok", None) and got["none"][0] == "error" and got["model"] == ("error", "division by zero") and got["cut"] == ("error", "circuit_open")
    assert not list(tmp_path.iterdir())
    assert not health.due(None, 5, 0, "health") and health.due(None, 10, 0, "health") and not health.due(10, 69, 0, "health") and health.due(10, 70, 0, "health")


def test_python_gets_and_gives_small_batches(spark):
    from lectern.functions import markdown, text
    from lectern.plans import arrow

    rows = spark.range(3).selectExpr("cast(id AS string) AS path", "cast('a b' AS binary) AS content", "'a b' AS t", "'simple' AS c")
    lists = text.tokens(F.col("t"))
    makers = [
        lambda: files.extracted(rows, lambda raw: iter([raw])), lambda: files.converted(rows, lambda raw: raw), lambda: models.generated(rows, "path", "t", lambda p: p), lambda: markdown.rendered("t"),
        lambda: text.lexemes(lists, F.col("c")), lambda: text.rank_texts(["a", "b"])(lists), lambda: text.language_scores("a b", ["simple"])(lists, F.col("c")),
    ]
    for make in makers:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
        make()
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == arrow.ROWS and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == arrow.BYTES
    sizes = [len(f) for f in files._frames((("p", k, b"x" * 900) for k in range(25)), ["path", "page_number", "content"], 10_000)]
    assert sizes == [10, 10, 5]
    held = text.Lexemes("german", frozenset())
    assert held.most <= 100_000
