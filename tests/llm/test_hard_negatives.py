import math

import duckdb
import numpy as np
import pytest

from lectern.llm import hard_negatives as hard
from lectern.llm import queries


def slow(rows, is_anchor, positives=5, negatives=3, window=(50, 95), scale=256.0):
    """From (vec_id, embedding, label), by comparing all with all."""
    held = [(i, y, [math.floor(scale * float(x)) for x in v]) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, a in held:
        if is_anchor(i):
            others = sorted((-sum(p * q for p, q in zip(a, b)), j, z) for j, z, b in held if j != i)
            for s, j, _ in [o for o in others if o[2] == y][:positives]:
                hits = [(n, m) for m, n, z in others if z != y and window[0] * -s <= 100 * -m <= window[1] * -s]
                out += [(i, j, r + 1, n, -s, -m) for r, (n, m) in enumerate(hits[:negatives])]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def odd_rows(n, clusters, seed, dims=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.3, (clusters, dims))
    rows = [(k, [float(x) for x in middle[k % clusters] + rng.normal(0, 0.05, dims)], int(k % clusters) // 2 if k % 5 else int(rng.integers(0, 4))) for k in range(n)]
    rows += [(n, None, 1), (n + 1, [None] * dims, 1), (n + 2, [float("nan")] * dims, 1), (n + 3, [float("inf")] * dims, 1), (None, [1.0] * dims, 1), (n + 4, [1.0] * dims, None), (n + 5, [0.0] * dims, 2)]
    rows += [(n + 10 + k, rows[50 % n][1], k % 3) for k in range(60)]  # equal vectors
    return rows + [rows[3]] * 4 + [(50, rows[7 % n][1], 1)]  # repeated rows, and another row of an anchor's id


@pytest.mark.parametrize(("n", "clusters", "chunk", "block"), [(700, 12, 160, 3), (700, 12, 16384, None), (400, 1, 100, 64), (30, 3, 4, 2)])
def test_against_brute_force(spark, n, clusters, chunk, block):
    rows = odd_rows(n, clusters, n + clusters)
    vectors = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], "vec_id long, embedding array<float>, label int, number string, score int").repartition(3)
    held = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    assert got(hard.mine(vectors, vectors.filter("vec_id % 50 = 0"), chunk=chunk, block=block)) == slow(held, lambda i: i % 50 == 0)


def test_other_numbers(spark):
    vectors = spark.createDataFrame(odd_rows(150, 6, 9), "vec_id long, embedding array<double>, label int")
    held = [tuple(r) for r in vectors.collect()]
    how = {"positives": 2, "negatives": 7, "window": (-40, 100), "scale": 64.0}
    assert got(hard.mine(vectors, vectors.filter("vec_id % 3 = 0"), **how)) == slow(held, lambda i: i % 3 == 0, **how)


def test_empty_tables_and_lone_labels(spark):
    vectors = spark.createDataFrame([(50, [1.0], 1), (1, [0.9], 2)], "vec_id long, embedding array<float>, label int")
    for v, a in ((vectors.limit(0), vectors.limit(0)), (vectors, vectors.limit(0)), (vectors.limit(0), vectors), (vectors, vectors)):
        assert got(hard.mine(v, a)) == []  # no row has a positive


def test_numbers_beyond_doubles_are_exact():
    ids, labels = np.arange(6), np.array([1, 1, 2, 2, 2, 2])
    data = np.array([[2**31 - 1, 1], [2**31 - 1, 0], [2**31 - 1, 7], [2**31 - 1, 5], [2**31 - 1, 6], [-(2**31), 3]])
    t = hard.BallTrees(ids, labels, data)
    q = np.array([[2**31 - 1, 1]])
    best = t.search(np.array([0]), np.array([1]), q, np.array([[-(2**63)]]), np.array([[(2**31 - 1) ** 2 + 6]]), 2, False)[0][0]
    assert best[0].tolist() == [4, 3] and best[1].tolist() == [(2**31 - 1) ** 2 + 6, (2**31 - 1) ** 2 + 5]


def test_trees_hold_every_row_once_and_bound_all_scores():
    rng = np.random.default_rng(3)
    data = np.floor(256 * np.append(rng.normal(0, 1, (900, 5)), np.ones((500, 5)), axis=0)).astype(np.int64)
    t = hard.BallTrees(np.arange(1400), rng.integers(0, 3, 1400), data)
    leaves = sorted((int(s), int(e)) for s, e, c in zip(t.start, t.end, t.child, strict=True) if c < 0)
    assert leaves[0][0] == 0 and leaves[-1][1] == 1400 and all(a[1] == b[0] for a, b in zip(leaves, leaves[1:], strict=False)) and max(e - s for s, e in leaves) <= hard.LEAF
    assert sorted(t.ids.tolist()) == list(range(1400))
    q = np.floor(256 * rng.normal(0, 1, (20, 5))).astype(np.int64)
    found = hard.Found(t, np.arange(20), np.zeros(20, int), q, np.zeros((20, 1), int), np.zeros((20, 1), int), 1, True)
    for n in range(len(t.start)):
        assert len(set(t.labels[t.start[n] : t.end[n]].tolist())) == 1
        most, least = found.bounds(np.arange(20), np.full(20, n))
        scores = t.data[t.start[n] : t.end[n]] @ q.T
        assert (scores.max(0) <= most).all() and (scores.min(0) >= least).all()


def test_clusters_are_pruned():
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 1, (64, 32))
    data = np.floor(256 * (middle[np.arange(8192) % 64] + rng.normal(0, 0.05, (8192, 32)))).astype(np.int64)
    t = hard.BallTrees(np.arange(8192), np.zeros(8192, int), data)
    found = hard.Found(t, np.arange(50), np.zeros(50, int), data[:50], np.full((50, 1), -(2**63)), np.full((50, 1), 2**63 - 1), 5, True)
    found.run()
    assert found.read < 0.1 * 50 * 8192


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    result = con.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({hard.SQL})").fetchall()
    assert result and got(queries.op13_hard_negatives(spark, f"/root/testdata/{sf}")) == sorted(result)
