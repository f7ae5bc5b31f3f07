"""Tables and indexes that keep what is written."""

import hashlib
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern import workload
from lectern.functions import text
from lectern.operators import search, text_index
from lectern.operators.store import Table, delete_pages, follow, write_pages
from lectern.operators.text_index import TextIndex

SF = "/root/testdata/sf0.001"
COLUMNS = ["page_id", "document_id", "page_number", "extraction_status", "original_markdown", "translated_markdown"]
QUESTIONS = ["nicht", "the and", "die heiten ung", "la de", "absent words", "", "the"]


@pytest.fixture(scope="module")
def tables(spark):
    return workload.documents(spark, SF).cache(), workload.pages(spark, SF).select(*COLUMNS).cache()


def files(folder):
    return {str(p): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(folder).rglob("*.parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def scores(df):
    return rows(df.select("page_id", "document_id", "fts_score"))


@pytest.mark.parametrize("places", [[[0, 5, 9]], [[0], [1]], [[0], [3]], [[0, 10], [1, 11]], [[0], []], [[4, 8, 20, 31], [1, 9, 30], [2, 10, 11, 40]], [list(range(0, 400, 2)), list(range(1, 400, 2))]])
def test_cover_density_as_an_expression(spark, places):
    df = spark.createDataFrame([(places,)], "places array<array<int>>")
    assert df.select(text_index.cover_density(F.col("places"), len(places))).first()[0] == pytest.approx(text.cover_density(places), abs=1e-12)


def test_stored_lists_find_what_texts_hold(spark, tables, tmp_path):
    docs, pages = tables
    index = TextIndex(f"{tmp_path}/index", 16)
    index.write(pages, docs, 0)
    for q in QUESTIONS:
        assert scores(index.text_scores(pages, docs, q)) == scores(search.text_scores(pages, docs, q)), q
    counted = {(r.lexeme, r.config): (r.pages, r.occurrences) for r in index.frequencies(spark, ["the", "and"]).collect()}
    tokens = [t for r in pages.select(text.tokens(F.col("original_markdown")).alias("t")).collect() for t in [r.t]]
    for w in ("the", "and"):
        assert counted[w, "simple"] >= (sum(w in t for t in tokens), sum(t.count(w) for t in tokens))


def test_a_query_lists_its_buckets_alone_and_runs_without_python(spark, tables, tmp_path):
    docs, pages = tables
    index = TextIndex(f"{tmp_path}/index", 16)
    index.write(pages, docs, 0)
    wanted = {b for (b,) in spark.createDataFrame([("the",), ("and",)], "w string").select(text_index.bucket_of(F.col("w"), 16)).collect()}
    plan = index.postings(spark, ["the", "and"])._jdf.queryExecution().executedPlan().toString()
    pruned = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(([\d,]+)\)", plan)
    assert {int(b) for b in pruned[1].split(",")} == wanted and "PushedFilters: [In(lexeme" in plan
    docs, pages = workload.documents(spark, SF), workload.pages(spark, SF)
    plan = index.text_scores(pages, docs, "the and")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert "text:string" not in plan and "original_markdown" not in plan


def test_index_after_writes_equals_a_rebuilt_one(spark, tables, tmp_path):
    docs, pages = tables
    table, index = Table(f"{tmp_path}/pages", "page_id", "document_id", 8), TextIndex(f"{tmp_path}/index", 16)
    table.create(pages)
    index.write(pages, docs, 0)
    first = files(tmp_path)
    document = pages.first().document_id
    change = pages.filter(F.col("document_id") == document).withColumn("original_markdown", F.when(F.col("page_id") % 2 == 0, "die heiten ung und nicht mehr")).withColumn("translated_markdown", F.lit("the end and the heiten ung"))
    write_pages(table, index, change, docs, 1)
    after = files(tmp_path)
    touched = {r[0] for r in change.select(F.pmod(F.xxhash64("document_id"), F.lit(8))).distinct().collect()}
    kept = {p: h for p, h in first.items() if not any(f"/_part={t}/" in p for t in touched)}
    assert len(kept) > len(first) / 2 and kept.items() <= after.items()  # other parts, and all postings of the first batch, are the same files
    now = pages.join(change.select("page_id"), "page_id", "left_anti").unionByName(change)
    assert rows(table.read(spark).select(*COLUMNS)) == rows(now.select(*COLUMNS))
    write_pages(table, index, change.withColumn("translated_markdown", F.lit("never written")), docs, 1)  # the same batch again is passed over
    assert rows(table.read(spark).select(*COLUMNS)) == rows(now.select(*COLUMNS))
    gone = now.filter("page_id % 9 = 4").select("page_id", "document_id")
    delete_pages(table, index, gone, docs, 2)
    now = now.join(gone.select("page_id"), "page_id", "left_anti")
    assert rows(table.read(spark).select(*COLUMNS)) == rows(now.select(*COLUMNS))
    rebuilt = TextIndex(f"{tmp_path}/again", 16)
    rebuilt.write(table.read(spark), docs, 0)
    columns = ["lexeme", "field", "config", "page_id", "positions", "tf"]
    assert rows(index.postings(spark).select(*columns)) == rows(rebuilt.postings(spark).select(*columns))
    assert rows(index.compacted(spark, f"{tmp_path}/small").postings(spark).select(*columns)) == rows(rebuilt.postings(spark).select(*columns))
    for q in QUESTIONS:
        assert scores(index.text_scores(now, docs, q)) == scores(search.text_scores(now, docs, q)), q


def test_a_batch_that_broke_off_does_not_count(spark, tables, tmp_path):
    docs, pages = tables
    index = TextIndex(f"{tmp_path}/index", 4)
    index.write(pages, docs, 0)
    before = rows(index.postings(spark).drop("batch"))
    text_index.postings_of(pages.limit(3), docs, 4).write.partitionBy("bucket").parquet(f"{index.path}/postings/batch=1")  # written, but not its pages
    assert rows(index.postings(spark).drop("batch")) == before


def test_upserts_change_add_and_keep(spark, tmp_path):
    table = Table(f"{tmp_path}/t", "id", "own", 4)
    table.create(spark.createDataFrame([(1, "a", 1, "x"), (2, "a", 2, "y"), (3, "b", 3, None)], "id long, own string, n int, s string"))
    assert table.upsert(spark.createDataFrame([(1, "a", 7), (1, "a", 5), (9, "c", 4), (3, "b", None)], "id long, own string, n int"), 5)
    assert rows(table.read(spark)) == [(1, "a", 7, "x"), (2, "a", 2, "y"), (3, "b", None, None), (9, "c", 4, None)]
    assert not table.upsert(spark.createDataFrame([(1, "a", 0)], "id long, own string, n int"), 5)
    assert table.delete(spark.createDataFrame([(1, "a"), (2, "a"), (77, "z")], "id long, own string"))
    assert rows(table.read(spark)) == [(3, "b", None, None), (9, "c", 4, None)]
    table.delete(table.read(spark))
    assert rows(table.read(spark)) == []
    table.upsert(spark.createDataFrame([(1, "a", 1, "back")], "id long, own string, n int, s string"))
    assert rows(table.read(spark)) == [(1, "a", 1, "back")]


def test_a_stream_of_pages_is_followed(spark, tables, tmp_path):
    docs, pages = tables
    table, index = Table(f"{tmp_path}/pages", "page_id", "document_id", 4), TextIndex(f"{tmp_path}/index", 4)
    table.create(pages.filter("page_id % 3 > 0"))
    index.write(pages.filter("page_id % 3 > 0"), docs, 0)
    for k in range(2):
        pages.filter(f"page_id % 6 = {3 * k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        follow(spark.readStream.schema(pages.schema).parquet(f"{tmp_path}/in"), table, index, docs, f"{tmp_path}/checkpoint").awaitTermination()
    assert rows(table.read(spark).select(*COLUMNS)) == rows(pages.select(*COLUMNS))
    assert scores(index.text_scores(pages, docs, "the and")) == scores(search.text_scores(pages, docs, "the and"))
    assert {p.parent.parent.name for p in Path(index.path).glob("postings/*/*/*.parquet")} == {"batch=0", "batch=1", "batch=2"}


def test_hybrid_search_over_stored_lists(spark, tmp_path):
    docs, pages = workload.documents(spark, SF), workload.pages(spark, SF)
    index = TextIndex(f"{tmp_path}/index", 8)
    index.write(pages, docs, 0)
    vector = list(pages.filter("embedding IS NOT NULL").first().embedding)
    for q in ("the and", "nicht", ""):
        plain, stored = (rows(search.hybrid_search(pages, docs, q, vector, index=i)) for i in (None, index))
        assert plain == stored and (plain or not q)


def test_postings_are_made_where_pages_lie(spark, tables):
    docs, pages = tables
    made = text_index.postings_of(pages, docs, 16)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "hashpartitioning(lexeme" not in plan
    got = {(r.lexeme, r.page_id): list(r.positions) for r in made.filter("field = 0").collect()}
    want = {}
    for r in pages.select("page_id", text.tokens(F.col("original_markdown")).alias("t")).collect():
        for at, x in enumerate(r.t):
            want.setdefault((x, r.page_id), []).append(at)
    assert got == want
    packs = text_index.packed(pages.coalesce(1), docs, 16).filter("field = 0")
    assert packs.count() == len({x for x, _ in got}) < len(got)  # one row has a lexeme's postings of many pages


def test_a_page_written_twice_in_a_batch_is_found(spark, tables, tmp_path):
    docs, pages = tables
    index = TextIndex(f"{tmp_path}/index", 4)
    index.write(pages.unionByName(pages), docs, 0)
    assert {r.page_id for r in index.matches(spark, "the and").collect()} == {r.page_id for r in search.text_scores(pages.withColumn("extraction_status", F.lit("completed")), docs.withColumn("status", F.lit("completed")), "the and").collect()}
