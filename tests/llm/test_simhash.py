import numpy as np
import pytest
import xxhash

from lectern.llm import simhash
from lectern.llm.common import words


def slow_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """By fingerprint the least one reachable, by comparing all pairs."""
    u = sorted(set(fps))
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in u}


def test_query_against_brute_force(spark, odd_docs, no_docs, data):
    extra = ["word%d and some more text that goes on %s" % (k % 3, "again " * (k % 5)) for k in range(30)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(200 + k, t) for k, t in enumerate(extra)], "doc_id long, text string")).union(spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    rows = docs.collect()
    fps = {r.text: slow_fingerprint(r.text) for r in rows}
    of = components(fps.values())
    least: dict = {}
    for r in rows:
        if r.doc_id is not None:
            c = of[fps[r.text]]
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), format(fps[r.text], "016x"), str(least.get(of[fps[r.text]]))) for r in rows)
    for split in (2, simhash.SPLIT):
        got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs, split).collect())
        assert got == want
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs, hot_rows=1).collect())
    assert got == want  # keys of more than one row go another way
    assert simhash.near_duplicates(no_docs).collect() == []


def test_bit_sliced_links_in_a_dense_bucket():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 40, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 40, 60, dtype=np.uint64)) for c in centre]))
    label = simhash.within(fps, block=64)
    of = components(map(int, fps))
    first = {int(fps[0]): 0}
    for k, x in enumerate(map(int, fps)):
        first.setdefault(of[x], k)
    assert [first[of[int(x)]] for x in fps] == label.tolist()


def test_a_chain_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    from lectern.llm.components import connected_components

    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
    assert connected_components(links.limit(0)).collect() == []
    star = spark.createDataFrame([(50, k) for k in range(40)] + [(50, 60), (60, 61), (70, 71)], "a long, b long")
    for hot in (1, 5, 10**6):
        assert {r.node: r.component for r in connected_components(star, hot).collect()} == {**{k: 0 for k in (*range(40), 50, 60, 61)}, 70: 70, 71: 70}


def test_every_path_covers_all_bits_once():
    for level, free in ((1, 48), (2, 36), (3, 27), (4, 20), (5, 15)):
        m = simhash.masks(level)
        assert len(m) == 4**level and max(64 - (x & (1 << 64) - 1).bit_count() for x in m) <= free + 1


@pytest.mark.parametrize(("send", "hot"), [(simhash.SEND_ROWS, 1), (0, simhash.HOT_ROWS)])
def test_keep_one_keeps_whole_rows(odd_docs, send, hot):
    odd_docs = odd_docs.withColumnRenamed("fp", "place")
    kept = simhash.keep_one(odd_docs, send_rows=send, hot_rows=hot)
    assert kept.columns == odd_docs.columns
    rows = odd_docs.collect()
    of = components(slow_fingerprint(r.text) for r in rows)
    assert kept.count() == len({of[slow_fingerprint(r.text)] for r in rows})
    assert {0} <= {r.doc_id for r in kept.collect()}


def test_rows_and_words_beyond_the_radius_are_abandoned(monkeypatch):
    fps = np.random.default_rng(5).integers(0, 1 << 63, 700).astype(np.uint64)
    fps[690] = fps[3] ^ np.uint64(5)
    joined = []
    monkeypatch.setattr(simhash, "_joined", lambda label, i, j: joined.extend(zip(i.tolist(), j.tolist(), strict=True)) or label)
    simhash.within(fps, 3)
    assert joined == [(3, 690)]
    assert len(simhash.within(np.repeat(fps[:1], 130), 3)) == 130 and len(joined) == 1 + 130 * 129 // 2
