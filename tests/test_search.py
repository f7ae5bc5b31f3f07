import pytest
from pyspark.sql import functions as F

from lectern import workload
from lectern.functions import text, vectors
from lectern.operators import search
from lectern.plans.rank import bucketed, deepest, fused, global_row_number, ranks_by_counting
from lectern.queries import vector

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return workload.documents(spark, SF).cache(), workload.pages(spark, SF).cache()


def small(spark):
    docs = spark.createDataFrame([("d1", "One", "completed", "en"), ("d2", "Two", "processing", "en"), ("d3", "Drei", "completed", "de")], "document_id string, title string, status string, target_language string")
    rows = [
        (1, "d1", 1, "completed", "El corredor corría", "The runner was running fast", [1.0, 0.0]),
        (2, "d1", 2, "completed", "otro", "Nothing here", [0.6, 0.8]),
        (3, "d2", 1, "completed", "run", "run", [1.0, 0.0]),
        (4, "d1", 3, "pending", "run", "run", [1.0, 0.0]),
        (5, "d3", 1, "completed", "run run run", None, None),
        (6, "d1", 4, "completed", "zero", None, [0.0, 0.0]),
    ]
    return docs, spark.createDataFrame([(*r[:3], None, *r[3:]) for r in rows], "page_id long, document_id string, page_number int, image_path string, extraction_status string, original_markdown string, translated_markdown string, embedding array<float>")


def test_statuses_gate_and_stems_match(spark):
    docs, pages = small(spark)
    found = {r.page_id: r.score for r in search.hybrid_search(pages, docs, "run", [1.0, 0.0], analyzer=None).collect()}
    assert set(found) == {1, 2, 5}  # 3: document in work; 4: page pending; 6: zero vector and no match
    assert found[1] == pytest.approx(1 / 61 + 1 / 62)  # second in text: `running` has the stem once, page 5 the word three times
    simple = {r.page_id for r in search.text_scores(pages, docs, "run", "simple").collect()}
    assert simple == {5}
    ready = search.indexed(pages, docs)
    for q in ("run", "the running", "corredor corría", "the"):
        plain, stored = ({r.page_id: r.fts_score for r in search.text_scores(p, docs, q).collect()} for p in (pages, ready))
        assert plain == stored and (plain or q == "the")


def test_document_search_is_scoped_and_floored(spark):
    docs, pages = small(spark)
    assert [r.page_id for r in search.document_search(pages, "d1", [1.0, 0.0], 5, 0.0).collect()] == [1, 2]
    assert [r.page_id for r in search.document_search(pages, "d1", [1.0, 0.0]).collect()] == [1, 2]
    assert [r.page_id for r in search.document_search(pages, "d1", [1.0, 0.0], min_similarity=0.7).collect()] == [1]
    assert [r.page_id for r in search.document_search(pages, "d2", [1.0, 0.0]).collect()] == [3]


@pytest.mark.parametrize("query", [None, ""])
def test_an_empty_query_finds_nothing(spark, query):
    docs, pages = small(spark)
    assert search.hybrid_search(pages, docs, query, [1.0, 0.0]).collect() == []
    assert search.hybrid_count(pages, docs, query, [1.0, 0.0]).first().total == 0


def test_the_floor_cuts_single_lists_at_rank_40(spark, tables):
    docs, pages = tables
    rows = search.combined(pages, docs, "nicht", vector(spark, SF)).collect()
    semantic = [r.semantic_rank for r in rows if r.fts_rank is None]
    matched = [r.fts_rank for r in rows if r.semantic_rank is None]
    both = [r for r in rows if r.semantic_rank and r.fts_rank]
    assert max(semantic) == 40 and max(matched) <= 40 and both
    assert max(r.semantic_rank for r in both) > 40
    assert not [r for r in search.combined(pages, docs, "nicht", vector(spark, SF), 100).collect() if r.fts_rank is None or r.semantic_rank is None]


def test_pages_of_results_join_to_the_whole_list(spark, tables):
    docs, pages = tables
    q = vector(spark, SF)
    whole = [r.page_id for r in search.hybrid_search(pages, docs, "the", q, limit=1000, highlight=False).collect()]
    parts = [r.page_id for o in range(0, len(whole) + 20, 30) for r in search.hybrid_search(pages, docs, "the", q, limit=30, offset=o, highlight=False).collect()]
    assert parts == whole and len(set(whole)) == len(whole)
    assert search.hybrid_count(pages, docs, "the", q).first().total == len(whole)


@pytest.mark.parametrize(("scores", "keys"), [(256, 64), (4, 3), (1, 1)])
@pytest.mark.parametrize("spread", [8, 100_000])
def test_global_row_numbers_without_a_single_partition(spark, scores, keys, spread):
    rows = [(k, float(k * 37 % spread) / 8) for k in range(3000)] + [(5000 + k, 0.5) for k in range(2000)] + [(-1, 7.0), (-2, -7.0)]
    df = spark.createDataFrame(rows, "id long, score double").repartition(5)
    numbered = global_row_number(df, "score", "id", "n", scores, keys, 0)
    want = {i: n for n, (i, s) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert {r.id: r.n for r in numbered.collect()} == want
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "CartesianProduct" not in plan and "ReusedExchange" in plan
    assert {r.id: r.n for r in global_row_number(df, "score", "id", "n").collect()} == want
    assert global_row_number(df.limit(0), "score", "id", "n").collect() == []


def test_cells_do_not_grow_with_the_rows(spark):
    """No cell has more than a few quantiles' share, whether scores are few or many."""
    for score in ("id % 3", "id * 7 % 1000003", "IF(id % 2 = 0, 0, id)"):
        df = spark.range(40_000).selectExpr("id", f"double({score}) score")
        bounds = df.agg(F.percentile_approx("score", [k / 256 for k in range(257)], 4096)).first()[0]
        assert len(set(bounds)) <= 257
        cells = {}
        numbered = global_row_number(df, "score", "id", "n", few=0)
        plan = numbered._jdf.queryExecution().optimizedPlan().toString()
        assert "_level" in plan and "_part" in plan
        levels = bucketed(bucketed(df, "score", sorted(set(bounds)), "l"), "id", [40_000 / 64 * k for k in range(64)], "p")
        for r in levels.groupBy("l", "p").count().collect():
            cells[r.l, r.p] = r["count"]
        assert max(cells.values()) < 4 * 40_000 / 64


def test_no_list_is_sorted_exchanged_or_written(spark, tables, tmp_path):
    from pathlib import Path

    from lectern.plans.keep import shared_folder
    from lectern.plans.rank import best

    for name, df in zip(("docs", "pages"), small(spark), strict=True):
        df.write.parquet(f"{tmp_path}/{name}")  # whose size is known
    docs, pages = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("docs", "pages"))
    assert deepest(0.01, 60) == 140 and deepest(0.01, 300) == 0
    for df, score in ((search.semantic_scores(pages, docs, [1.0, 0.0]), "semantic_score"), (search.text_scores(pages, docs, "run fast"), "fts_score")):
        plan = best(df, score, "page_id", 140)._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in plan and "Exchange" not in plan.replace("BroadcastExchange", "") and "Window" not in plan
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.rglob("*"))
    docs, pages = tables
    assert search.hybrid_search(pages, docs, "nicht", vector(spark, SF)).count() == 20
    assert set(folder.rglob("*")) == before


@pytest.mark.parametrize("key", ["id", "'k' || lpad(id + 10, 6, '0')"])
@pytest.mark.parametrize("spread", [3, 40, 100_000])
def test_ranks_by_counting_are_row_numbers(spark, spread, key):
    df = spark.range(2500).selectExpr(f"{key} AS key", f"double(id * 37 % {spread}) / 8 AS score").unionByName(spark.range(1).selectExpr(f"{key.replace('id', '5000')} AS key", "-7.5D AS score")).repartition(5)
    order = sorted(((r.score, r.key) for r in df.collect()), key=lambda x: (-x[0], x[1]))
    asked = order[:3] + order[700:800:7] + order[-2:]
    assert ranks_by_counting(df, "score", "key", asked) == {k: order.index((s, k)) + 1 for s, k in asked}
    assert ranks_by_counting(df, "score", "key", []) == {} and ranks_by_counting(df.limit(0), "score", "key", asked[:1]) == {asked[0][1]: 1}


def test_fused_lists_against_full_ranks(spark, tables):
    docs, pages = tables
    for query, k in (("the", 60), ("nicht", 20), ("die heiten ung", 60), ("the and", 90)):
        semantic = {r.page_id: r for r in search.semantic_ranked(pages, docs, vector(spark, SF)).collect()}
        matched = {r.page_id: r for r in search.text_ranked(pages, docs, query).collect()}
        want = {}
        for i in semantic.keys() | matched.keys():
            a, b = semantic.get(i), matched.get(i)
            score = (1 / (k + a.semantic_rank) if a else 0) + (1 / (k + b.fts_rank) if b else 0)
            if score >= 0.01:
                want[i] = (a.semantic_rank if a else None, b.fts_rank if b else None, a.semantic_score if a else 0, b.fts_score if b else 0, pytest.approx(score))
        assert {r.page_id: (r.semantic_rank, r.fts_rank, r.semantic_score, r.fts_score, r.rrf_score) for r in search.combined(pages, docs, query, vector(spark, SF), k).collect()} == want


def test_stop_words_stay_whatever_was_asked_before(spark):
    docs, pages = small(spark)
    search.text_scores(pages, docs, "the").collect()  # no term in English
    found = search.indexed(pages, docs).filter("page_id = 1").first().translated_searchable
    assert found == ["", "runner", "", "run", "fast"]


def test_texts_of_results_alone_are_read(spark, data):
    docs, pages = workload.documents(spark, data), workload.pages(spark, data)
    plan = search.hybrid_search(pages, docs, "nicht", vector(spark, data))._jdf.queryExecution().executedPlan().toString()
    for scan in plan.split("FileScan parquet")[1:]:
        head = scan.split("\n")[0]
        assert "text" not in head.split("]")[0] or "In(doc_id" in head or "doc_id IN" in head or "EqualTo(doc_id" in head
    assert "FileScan" in plan


def test_cover_density_is_linear():
    import time

    began = time.perf_counter()
    text.cover_density([list(range(0, 200_000, 2)), list(range(1, 200_000, 2))])
    assert time.perf_counter() - began < 3

def test_ranking_reads_no_text_for_the_semantic_list(spark, data):
    docs, pages = workload.documents(spark, data), workload.pages(spark, data)
    plan = search.semantic_scores(pages, docs, vector(spark, data))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "text:string" not in plan and "Window" not in plan
    top = search.document_search(pages, "src1-en", vector(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top


def test_cosine_forms_agree(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [-1.0, -2.0])], "id int, v array<float>")
    q = [1.0, 2.0]
    got = {r.id: (r.a, r.b) for r in df.select("id", vectors.cosine(F.col("v"), q).alias("a"), vectors.cosine_batches(q)("v").alias("b")).collect()}
    assert got == {1: (1.0, 1.0), 2: (None, None), 3: (None, None), 4: (None, None), 5: (-1.0, -1.0)}


def test_rrf_is_in_doubles(spark):
    row = spark.range(1).select(fused(F.lit(1), F.lit(None), 60).alias("x")).first()
    assert row.x == 1 / 61


@pytest.mark.parametrize(("word", "stem"), [("running", "run"), ("runner", "runner"), ("flies", "fli"), ("happily", "happili"), ("generously", "generous"), ("hopping", "hop"), ("national", "nation"), ("skies", "sky"), ("consistency", "consist"), ("knightly", "knight"), ("relational", "relat"), ("news", "news"), ("cries", "cri"), ("ties", "tie"), ("dying", "die")])
def test_english_stems(word, stem):
    assert text.stem_english(word) == stem


@pytest.mark.parametrize(("word", "stem"), [("häuser", "haus"), ("aufeinanderfolge", "aufeinanderfolg"), ("kategorischer", "kategor"), ("kaufleute", "kaufleut"), ("möglichkeit", "moglich"), ("katers", "kat")])
def test_german_stems(word, stem):
    assert text.stem_german(word) == stem


def test_cover_density():
    assert text.cover_density([[0, 5, 9]]) == pytest.approx(0.3)
    assert text.cover_density([[0], [1]]) == pytest.approx(0.1)
    assert text.cover_density([[0], [3]]) == pytest.approx(0.1 / 3)
    assert text.cover_density([[0, 10], [1, 11]]) == pytest.approx(0.1 + 0.1 / 9 + 0.1)
    assert text.cover_density([[0], []]) == 0


def test_headlines():
    words = " ".join(f"w{k}" for k in range(100))
    out = text.headline(words, ["w50"])
    assert "<b>w50</b>" in out and len(out.split()) <= 35
    assert text.headline(words, ["none"]) == " ".join(f"w{k}" for k in range(15))
    assert text.headline(None, ["x"]) is None


@pytest.mark.parametrize(
    ("language", "pairs"),
    [
        ("spanish", "cheques chequ chica chic chilena chilen torneos torne torres torr tortura tortur canciones cancion rápidamente rapid haciéndolo hac cantando cant gobierno gobiern"),
        ("french", "continua continu continuait continu continuellement continuel continuité continu contraindre contraindr contradictoire contradictoir majesté majest majestueusement majestu maison maison maître maîtr chevaux cheval nationale national"),
        ("swedish", "jakt jakt jaktkarlarne jaktkarl klo klo klockan klockan klockor klock kloster klost möjligheter möj"),
        ("danish", "indtage indtag undersøgelse undersøg hændelser hænd venlighed ven bestemmelse bestem barnlige barn"),
        ("portuguese", "boas boas boatos boat quilométricas quilométr quilômetros quilômetr quilombos quilomb quilos quil químicos químic quimioterapia quimioterap"),
        ("italian", "abbandonata abbandon abbandonare abbandon pronto pront pronunciamento pronunc propaga propag propagare propag"),
        ("dutch", "lichaamsziek lichaamsziek lichamelijk licham lichamelijkheden licham opgave opgav opgehangen opgehang mogelijkheid mogelijk katten kat"),
        ("norwegian", "havnedistriktene havnedistrikt opning opning opninga opning oppmerksomhet oppmerksom hastighet hast"),
    ],
)
def test_other_stems(language, pairs):
    words = pairs.split()
    assert [text.STEMMERS[language](w) for w in words[::2]] == words[1::2]


@pytest.mark.parametrize("language", sorted(text.STEMMERS))
def test_stemmers_take_any_word(language):
    for word in ("", "a", "s", "e", "qu", "yyy", "äöü", "é", "ß" * 5, "1234", "ement", "mente", "heten", "ions", "漢字"):
        assert isinstance(text.STEMMERS[language](word), str)


def test_words_begin_with_the_pattern_of_their_stem():
    """Over every word of the tables, in every configuration: the filter before the analysis loses none."""
    import re

    import duckdb

    found = duckdb.sql(r"SELECT DISTINCT unnest(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')) AS w FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    vocabulary = [w for (w,) in found if w] + "skies dying lying tying news constamment chevaux heureuse mogelijkheden brood maan straße häuser fräulein communicatrice".split()
    assert len(vocabulary) > 5_000
    for stem in text.STEMMERS.values():
        patterns: dict = {}
        for w in vocabulary:
            s = stem(w)
            if s not in patterns:
                patterns[s] = re.compile(text.stem_pattern(s)) if s else None
            assert patterns[s] is None or patterns[s].match(w), (w, s)
