import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import lm
from lectern.llm.common import words


def slow(rows, mu=lm.MU):
    end, start = " end", " start"
    text = [[w.decode() for w in words(t)] + [end] for _, t in rows]
    held = [i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    one, two, three, contexts, starts = Counter(), Counter(), Counter(), Counter(), 0
    for w, h in zip(text, held, strict=True):
        if not h:
            one.update(w)
            starts += 1
            two.update(zip([start, *w[:-1]], w, strict=True))
            three.update(zip([start, *w][: len(w) - 1], w[:-1], w[1:], strict=True))
    contexts = {**one, start: starts}
    n, v = sum(one.values()), len(one)
    plain = lambda w: (one[w] + 1) / (n + v + 1)
    second = lambda a, b: (two[a, b] + mu[0] * plain(b)) / (contexts.get(a, 0) + mu[0])
    third = lambda a, b, c: (three[a, b, c] + mu[1] * second(b, c)) / (two[a, b] + mu[1])
    out = []
    for (i, _), w, h in zip(rows, text, held, strict=True):
        score = math.log10(second(start, w[0])) + sum(math.log10(third(*x)) for x in zip([start, *w][: len(w) - 1], w[:-1], w[1:], strict=True))
        out.append((str(i), h, len(w), sum(one[x] > 0 for x in w), n, sum(math.log10(plain(x)) for x in w), score))
    return out


@pytest.mark.parametrize("sizes", [{}, {"block_tokens": 300}, {"block_tokens": 5000, "part_tokens": 100, "shard_tokens": 700}])
def test_query_against_brute_force(spark, odd_docs, no_docs, data, sizes):
    docs = odd_docs.select("doc_id", "text").union(spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((str(r.doc_id), *r[1:]) for r in lm.score_documents(docs, **sizes).collect())
    for a, b in zip(got, sorted(slow(rows)), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert abs(a[6] - b[6]) <= 0.5001 * lm.STEP * a[2] + 1e-9  # half a step of the codes a token
    assert any(r[1] for r in got) and lm.score_documents(no_docs).collect() == []


def test_without_training_documents(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score_documents(docs).collect()) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]


def test_elias_fano_finds_what_is_there():
    rng = np.random.default_rng(0)
    for n, universe in ((0, 10), (1, 1), (5, 6), (1000, 1 << 20), (3000, 1 << 62), (500, 500)):
        values = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
        level = lm.EliasFano(values, universe)
        asked = np.concatenate((values, rng.integers(0, universe, 500, dtype=np.uint64)))
        place = {int(v): k for k, v in enumerate(values)}
        assert level.find(asked).tolist() == [place.get(int(x), -1) for x in asked]


def test_elias_fano_gives_numbers_back():
    rng = np.random.default_rng(3)
    for n, universe in ((1, 1), (5, 6), (1000, 1 << 20), (3000, 1 << 62), (500, 50)):
        values = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
        assert (lm.EliasFano(values, universe).access(np.arange(n)) == values).all()


def small_trie(rng, n=2000):
    """A trie of three levels and the n-grams in it."""
    word_keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) << np.uint64(1)
    pairs = np.unique(np.stack((rng.integers(0, len(word_keys) // 2, 3 * n), rng.integers(0, 50, 3 * n))), axis=1)  # half of the words have no successors
    triples = np.unique(np.stack((rng.integers(0, pairs.shape[1], 4 * n), rng.integers(0, 1 << 32, 4 * n))), axis=1)
    counts = [rng.integers(1, 99, k) for k in (len(word_keys), pairs.shape[1], triples.shape[1])]
    trie = lm.Trie(word_keys, counts[0], pairs[0], pairs[1].astype(np.uint64), counts[1], triples[0], triples[1].astype(np.uint64), counts[2])
    return trie, word_keys, pairs, triples, counts


def test_trie_holds_probabilities_and_weights():
    rng = np.random.default_rng(1)
    trie, word_keys, pairs, triples, counts = small_trie(rng)
    got = trie.ask(word_keys, pairs[0], pairs[1].astype(np.uint64), triples[0], triples[1].astype(np.uint64))
    assert (got[0] == counts[0]).all()
    for codes, want in zip(got[1:], (lm.MU[0] / (counts[0] + lm.MU[0]), counts[1] / (counts[0][pairs[0]] + lm.MU[0]), lm.MU[1] / (counts[1] + lm.MU[1]), counts[2] / (counts[1][triples[0]] + lm.MU[1])), strict=True):
        assert np.allclose(lm.VALUES[codes], np.minimum(want, 1), rtol=3e-4)  # the counts are no real ones
    absent = trie.ask(word_keys ^ np.uint64(2), pairs[0], pairs[1].astype(np.uint64), triples[0], triples[1].astype(np.uint64))
    assert all((x == 0).mean() > 0.99 for x in absent)
    for part in (trie.triple_mass, trie.triples.values.low, trie.pairs.pointers.bits):
        assert isinstance(part.base, np.memmap)


def test_ranges_are_read_through_the_pointers():
    rng = np.random.default_rng(2)
    trie, word_keys, pairs, triples, _ = small_trie(rng)
    asked = (word_keys, pairs[0], pairs[1].astype(np.uint64), triples[0], triples[1].astype(np.uint64))
    right = trie.ask(*asked)
    # a successor of another context is none of this one, though it is in the level
    other = (pairs[0] + 1) % len(word_keys)
    order = np.argsort(other, kind="stable")
    have = {(a, b) for a, b in pairs.T.tolist()}
    got = trie.pairs.find(other[order], pairs[1][order].astype(np.uint64)) >= 0
    assert got.tolist() == [(a, b) in have for a, b in zip(other[order].tolist(), pairs[1][order].tolist(), strict=True)] and not got.all() and got.any()
    kept, trie.pairs.pointers = trie.pairs.pointers, lm.EliasFano(np.zeros(len(word_keys) + 1, np.uint64), 1)
    assert (trie.ask(*asked)[2] != right[2]).mean() > 0.9
    trie.pairs.pointers, trie.triples.pointers = kept, None
    with pytest.raises(AttributeError):
        trie.ask(*asked)


def test_codes_are_close_for_every_share():
    shares = np.array([1.0, 0.5, 1e-3, 1.2345e-9, 3e-14])
    assert np.allclose(lm.VALUES[lm.quantise(shares)], shares, rtol=3e-4) and lm.VALUES[0] == 0


def test_a_block_without_training_documents_is_answered():
    """The trie is built from other blocks' counts alone."""
    train, held = (next(lm.blocks([lm.pa.record_batch([[1], [text], [out]], ["i", "t", "h"])])) for text, out in (("a b c a b d", False), ("a b c x", True)))
    none = np.empty(0, np.uint64)
    asked = []
    for block in (train, held):
        block.deal(1, none, none)
        asked.append(lm.question(block, block.counts(), 0))
    answers = [lm._split(x) for x in lm.part_answers(asked, none, np.empty(0, np.int64))]
    count = lm.numbers(answers[1][0], np.int64)
    assert sorted(count.tolist()) == [0, 1, 1, 1, 2, 2]  # x; c, end and start; a, b
    mass = lm.VALUES[lm.numbers(answers[1][4], np.uint16)]
    assert sorted(np.round(mass[mass > 0] * (2 + lm.MU[1]), 2)) == pytest.approx([1.0, (2 + lm.MU[1]) / (1 + lm.MU[1])], rel=1e-2)


def test_frequent_words_are_dealt_to_many_shards():
    text = " ".join(f"the of {k}" for k in range(400))
    block = next(lm.blocks([lm.pa.record_batch([[1], [text], [False]], ["i", "t", "h"])]))
    none = np.empty(0, np.uint64)
    hashes = np.sort(np.array([lm.xxhash.xxh3_64_intdigest(w) for w in (b"the", b"of")], np.uint64))
    most = []
    for very in (none, hashes):
        for often in (none, hashes):
            block.deal(16, often, very)
            most.append(max(np.diff(block.bounds[2])))
            assert len(block.triple_of) == len(block.triple_p) and sorted(block.pair_of[block.pair_slot].tolist()) == list(range(len(block.pair_a)))
    assert most[3] < 0.4 * most[0]


def test_the_model_beats_the_base_on_held_out_text(spark):
    rows = lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_tasks_with_several_shards_give_the_same(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60).repartition(3)
    rows = lambda: sorted((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score_documents(docs, block_tokens=2000, part_tokens=500, shard_tokens=1000).collect())
    one_each = rows()
    monkeypatch.setattr(lm, "TASKS", 2)
    assert rows() == one_each
