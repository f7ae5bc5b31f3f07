import numpy as np
import pytest

from lectern.llm import topk


def slow(rows, k):
    vectors = [(i, [int(np.floor(64.0 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in vectors:
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize(("n", "chunk", "block"), [(700, 150, 7), (700, 8192, 1024), (700, 100, None), (15, 4, 2)])
def test_query_against_brute_force(spark, n, chunk, block):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 16)]) for i in range(n)]
    rows += [(n, None), (n + 1, [None] * 16), (n + 2, [float("nan")] * 16), (n + 3, [float("inf")] * 16), (None, [1.0] * 16), (n + 5, [0.0] * 16)]
    rows += [(n + 10 + i, list(rows[20 % n][1])) for i in range(30)]  # ties
    vectors = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, block string, n int").repartition(3)
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20, chunk, block).collect())
    assert got == slow(rows, 20)


def test_empty_and_extreme_vectors(spark):
    vectors = spark.createDataFrame([(0, [3e38, -3e38]), (1, [3e38, 1.0]), (2, [1.0]), (3, [])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(vectors, vectors.filter("vec_id = 0"), 5).orderBy("rank").collect()]
    assert [g[2] for g in got] == [1, 2, 3] and got[-1][3] == 0 and got[0][3] > 2**61
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).collect() == []
    assert topk.top_k(vectors, vectors.limit(0)).collect() == []


def test_repeated_rows_take_part_each_for_itself(spark):
    vectors = spark.createDataFrame([(20, [1.0]), (20, [2.0]), (1, [1.0]), (1, [1.0])], "vec_id long, embedding array<float>")
    rows = topk.top_k(vectors, vectors.filter("vec_id = 1").limit(1), 5).collect()
    assert sorted(r.vec_id for r in rows) == [20, 20]


def test_own_rows_are_no_candidates_however_many(spark):
    rng = np.random.default_rng(5)
    for own, rest in ((100, 5), (100, 90), (3000, 400), (1, 2000)):
        ids = np.append(np.full(own, 20), np.arange(100, 100 + rest))
        data = rng.integers(-9, 9, (own + rest, 6))
        found, score = topk.ImpactIndex(ids, data).top(20, data[0], 20)
        right = sorted((-int(x @ data[0]), int(i)) for i, x in zip(ids, data, strict=True) if i != 20)[:20]
        assert list(zip((-score).tolist(), found.tolist(), strict=True)) == right
    vectors = spark.createDataFrame([(20, [1.0, 2.0])] * 300 + [(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    rows = topk.top_k(vectors, vectors.filter("vec_id = 20"), 20).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in rows] == [(k, 4) for k in range(1, 21)]  # 300 queries of one id share a list
    rows = topk.top_k(vectors, vectors.filter("vec_id = 20").limit(1), 20).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in rows] == [(1, 4), (2, 3), (3, 2), (4, 1), (5, 0)]


def test_few_vectors_are_rescored():
    rng = np.random.default_rng(6)
    data = np.floor(64 * rng.normal(0, 0.12, (4000, 64))).astype(np.int64)
    index = topk.ImpactIndex(np.arange(4000), data)
    left = [len(index._possible(data[j], 20, np.flatnonzero(np.arange(4000) != j))) for j in range(0, 4000, 100)]
    assert max(left) <= max(160, 4000 * topk.RESCORE)


def test_packs_are_numbered_and_full(spark):
    vectors = spark.createDataFrame([(7, [1.0])] * 900 + [(i, [2.0]) for i in range(300)], "vec_id long, embedding array<float>").repartition(3)
    rows, n = topk.packs(vectors, 100, 1, True)
    found = rows.collect()
    assert n == 12 and sorted(r.number for r in found) == list(range(12)) and sum(r.n for r in found) == 1200 and max(r.n for r in found) <= 110
