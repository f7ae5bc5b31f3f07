"""Centroid lists and the grouped vector join, against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import vectors
from lectern.operators import rag, vector_join
from lectern.operators.vector_index import VectorIndex


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or not any(a) or not any(b) or any(x is None or not math.isfinite(x) for x in [*a, *b]):
        return None
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b)), 9)


def brute(rows, query, k):
    scored = [(-c, i) for i, v in rows if (c := cosine(v, query)) is not None]
    return [i for _, i in sorted(scored)[:k]]


def clustered(n, seed=1, dims=24):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (25, dims))
    return [(k, [float(x) for x in middle[k % 25] + rng.normal(0, 0.3, dims)]) for k in range(n)]


def test_centroid_lists(spark, tmp_path):
    rows = clustered(3000)
    odd = [(9000, None), (9001, [0.0] * 24), (9002, [float("nan")] * 24), (9003, [1.0, 2.0]), (None, [1.0] * 24)]
    df = spark.createDataFrame([*rows, *odd], "id long, vector array<float>")
    rows = [(r.id, r.vector) for r in df.collect() if r.id is not None]
    index = VectorIndex(f"{tmp_path}/v", "id")
    index.create(df, 40)
    centre, probes = index.centroids(spark)
    assert len(centre) == 40 and probes < 20  # clusters: a part of the lists is enough
    found = right = 0
    for q in (7, 11, 100, 1234, 2999, 500, 42, 77):
        want = brute(rows, rows[q][1], 10)
        found += len(set(want) & {r.id for r in index.search(spark, rows[q][1], 10).collect()})
        right += len(want)
        assert [r.id for r in index.search(spark, rows[q][1], 10, probes=1, exact=True).collect()] == want
    assert found >= 0.9 * right
    plan = index.search(spark, rows[5][1], 10, probes=3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(no" in plan.replace("PartitionFilters: [no", "PartitionFilters: [isnotnull(no") and "TakeOrderedAndProject" in plan
    assert index.search(spark, [0.0] * 24, 3).collect() == [] and index.search(spark, [1.0], 3).collect() == []


def test_lists_follow_writes(spark, tmp_path):
    rows = clustered(600, 2)
    frame = lambda r: spark.createDataFrame(r, "id long, vector array<float>")
    index = VectorIndex(f"{tmp_path}/v", "id")
    index.create(frame(rows), 12)
    new = [(i, [-x for x in v]) for i, v in rows if i % 10 == 0] + [(5000, rows[3][1])]
    for _ in range(2):  # a batch that is written again counts once
        index.write(frame(new), 1, removed=frame([r for r in rows if r[0] % 10 == 1]))
    now = {i: v for i, v in rows if i % 10 != 1} | dict(new)
    stored = [(r.id, r.vector) for r in frame(list(now.items())).collect()]
    for q in (3, 10, 77):
        assert [r.id for r in index.search(spark, rows[q][1], 5, exact=True).collect()] == brute(stored, rows[q][1], 5)


def test_recall_on_the_tables(spark, tmp_path):
    """Vectors without clusters, where many lists have to be read: their number is measured when the index is made."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    index = VectorIndex(f"{tmp_path}/v", "vec_id")
    index.create(v)
    rows = [(r.vec_id, list(r.vector)) for r in v.collect()]
    m = np.array([x for _, x in rows], float)
    ids = np.array([i for i, _ in rows])
    hit = 0
    for q in range(0, 2000, 250):
        want = set(ids[np.lexsort((ids, -(m @ m[q])))[:10]].tolist())
        hit += len(want & {r.vec_id for r in index.search(spark, rows[q][1], 10).collect()})
    assert hit >= 0.9 * 80


def test_empty_vectors_make_an_empty_index(spark, tmp_path):
    index = VectorIndex(f"{tmp_path}/v", "id")
    index.create(spark.createDataFrame([], "id long, vector array<float>"))
    assert index.search(spark, [1.0], 3, exact=True).collect() == []


@pytest.mark.parametrize("packs", [(3, 7), (512, 2048)])
def test_many_questions_at_once(spark, packs):
    rng = np.random.default_rng(3)
    vector = lambda: [float(x) for x in rng.integers(-2, 3, 4)]  # noqa: E731  few values: many ties
    pages = [(k, "hot" if k % 3 else f"d{k % 7}", vector()) for k in range(150)] + [(900, "hot", None), (901, "hot", [0.0] * 4), (902, "hot", [1.0]), (903, None, [1.0] * 4), (904, "hot", [float("inf")] * 4)]
    asked = [(f"q{k}", ["hot", "d1", "d2", "none"][k % 4], vector()) for k in range(40)] + [("null", "hot", None), ("short", "hot", [2.0]), ("lost", None, [1.0] * 4)]
    df = lambda rows, key: spark.createDataFrame(rows, f"{key}, document_id string, vector array<double>")
    got = {}
    for r in vector_join.nearest(df(asked, "question string"), df(pages, "page_id long"), 3, -0.2, *packs).collect():
        got.setdefault(r.question, []).append((-r.similarity, r.page_id))
    want = {}
    for q, d, v in asked:
        best = sorted((-c, i) for i, own, x in pages if own == d and d is not None and (c := cosine(x, v)) is not None and c >= -0.2)[:3]
        if best:
            want[q] = best
    assert {q: sorted(x) for q, x in got.items()} == want
    plan = vector_join.nearest(df(asked, "question string"), df(pages, "page_id long"), 3, -0.2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_asking_about_many_documents(spark):
    docs = spark.createDataFrame([("a", "A"), ("b", "B")], "document_id string, title string")
    pages = spark.createDataFrame([(1, "a", 1, "completed", "one", None, [1.0, 0.0]), (2, "a", 2, "completed", "two", "zwei", [0.8, 0.6]), (3, "b", 1, "completed", "three", None, [0.0, 1.0]), (4, "b", 2, "pending", "four", None, [1.0, 0.0])], "page_id long, document_id string, page_number int, extraction_status string, original_markdown string, translated_markdown string, embedding array<double>")
    asked = spark.createDataFrame([(1, " what? ", "a", [1.0, 0.0]), (2, "what?", "b", [1.0, 0.0]), (3, "  ", "a", [1.0, 0.0]), (4, "what?", "gone", [1.0, 0.0]), (5, "x", "b", None)], "conv_id long, question string, document_id string, vector array<double>")
    past = spark.createDataFrame([(1, [("user", "before")])], "conv_id long, history array<struct<role:string,content:string>>")
    found = {r.conv_id: r for r in rag.ask_many(asked, pages, docs, past).collect()}
    assert set(found) == {1, 2, 5}
    assert found[1].context == f"[Page 1]\none{rag.BREAK}[Page 2]\nzwei" and [m.content for m in found[1].messages[1:]] == ["before", "what?"]
    assert found[2].context == found[5].context == "" and 'document "B"' in found[2].messages[0].content
    one = rag.ask(pages.select("*"), docs.withColumn("status", F.lit("completed")), "a", "what?", [1.0, 0.0]).first()
    assert one.context == found[1].context and vectors.DIGITS == 9
