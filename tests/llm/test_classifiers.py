import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import common, quality_model, queries, toxicity

from . import slow


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    y = np.asarray(labels)
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize(("name", "label", "folds", "held", "threshold"), [("op7_quality", "quality", 5, 0, 0.3), ("op3_toxicity", "toxic", 3, 1, 0.7)])
def test_held_out_accuracy(spark, name, label, folds, held, threshold):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf).collect()
    assert len(got) == 1000
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    rows = [(r.score, labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert auc([r[0] for r in rows], [r[1] for r in rows]) > 0.9
    assert np.mean([r[1] == r[2] for r in rows]) > 0.9


def test_odd_rows_are_scored_one_by_one(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(k, k % 2, (k + 1) % 2, "x") for k in range(13)] + [(None, 1, 1, "x"), (4, None, None, "x"), (4, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    for scored, empty in (
        (quality_model.apply_model(odd_docs, quality_model.fit(odd_docs, labels)), quality_model.apply_model(no_docs, quality_model.fit(no_docs, labels))),
        (toxicity.apply_index(odd_docs, toxicity.fit(odd_docs, labels)), toxicity.apply_index(no_docs, toxicity.fit(no_docs, labels))),
    ):
        rows = scored.collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows) and all(r.held_out is not None for r in rows)
        assert empty.collect() == []
    unlabelled = quality_model.apply_model(odd_docs, quality_model.fit(odd_docs, labels.limit(0)))
    assert {r.score for r in unlabelled.collect()} == {0.5}
    assert {r.score for r in toxicity.apply_index(odd_docs, toxicity.fit(odd_docs, labels.limit(0))).collect()} == {0.5}


def test_keep_good_keeps_whole_rows(odd_docs):
    model = quality_model.train([(b"good words here " * 5, 1), (b"### $$$ ***" * 9, 0)] * 20)
    kept = quality_model.keep_good(odd_docs, model)
    assert kept.columns == odd_docs.columns
    want = [r for r in odd_docs.collect() if quality_model.score((r.text or "").encode(), *model) >= 0.3]
    assert kept.count() == len(want)


def test_features_count_words_pairs_and_grams():
    n = len(quality_model.features(b"ab ab c"))
    # padded text of 9 bytes: 8 + 7 + 6 grams, 3 words, 2 pairs, 1 repetition
    assert n == 8 + 7 + 6 + 3 + 2 + 1
    assert len(quality_model.features(b"")) == 1  # two blanks make one pair of characters


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    bad = [f"bad{chr(97 + k)}{chr(97 + k)}" for k in range(12)]
    examples = []
    for i in range(1500):
        y = int(i % 3 == 0)
        words = ["plain%d" % w for w in rng.integers(0, 50, 20)] + ([bad[k] for k in rng.integers(0, 12, rng.integers(1, 6))] if y or i % 100 == 1 else [])
        examples.append((i, " ".join(words), y))
    index = toxicity.NearestExamples(examples)
    assert index.n_blocks > 5 and len(index.term) > 10
    dense = np.zeros((len(index.ids), len(index.term)))
    for t, (_, _, of) in index.blocks.items():
        for b, (at, w) in of.items():
            dense[b * toxicity.BLOCK + at, t] = w
    assert np.allclose(np.linalg.norm(dense, axis=1), 1)
    for _, text, _ in examples[:300]:
        at, cosine = index.nearest(text)
        terms, weights = index._weights(text)
        scores = dense[:, terms] @ weights if len(terms) else np.zeros(len(dense))
        want = [k for k in np.lexsort((np.arange(len(scores)), -np.round(scores, 12)))[: toxicity.NEAREST] if scores[k] > 0]
        assert at.tolist() == want and np.allclose(cosine, scores[want])


def test_whole_texts_of_both_labels_are_searched():
    plain = [(i, f"meadow river stone{i} lantern", 0) for i in range(40)]
    index = toxicity.NearestExamples([*plain, (90, "a vile remark", 1), (91, "", 1)])
    assert len(index.ids) == 41 and index.labels.sum() == 1
    (_, nearest, cosine), (_, rare, _) = index.scores(["Lantern stone7 meadow", "vile"])
    assert nearest[0] == 7 and 0.5 < cosine < 1 and rare == [90]
    assert list(index.scores(["nothing shared"])) == [(index.prior, [], 0.0)]


def test_terms_are_all_words_and_beginnings():
    assert toxicity.terms("Über-see Überseen") == {"über", "see", "überseen", "übe*", "über*"}
    assert toxicity.terms("") == set()
    texts = [f"tree only{chr(97 + i % 26)}{i}" + " vile" * (i < 2) for i in range(100)]
    index = toxicity.NearestExamples([(i, t, int(i < 2)) for i, t in enumerate(texts)])
    assert set(index.term) == set().union(*map(toxicity.terms, texts))  # also those of one example
    assert index.nearest("vile")[0].tolist() == [0, 1] and index.nearest("onlya0")[0][0] == 0 and len(index.nearest("onlyx")[0]) == toxicity.NEAREST
    assert len(index.nearest("nothing")[0]) == 0


def test_all_examples_of_a_rare_label_are_learned(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 40 == 0)) for i in range(400)], "doc_id long, toxic int")
    index = toxicity.opened(toxicity.fit(docs, labels, usable=lambda doc_id: doc_id >= 0, sample=30))
    assert len(index.ids) == 30 and sorted(index.ids[index.labels == 1].tolist()) == list(range(0, 400, 40))
    assert index.prior == pytest.approx(11 / 402)


TEXTS = [b"", b" ", b"a", b"ab ab c", "Stra\u00dfe \U0001f600\tx\ny  y".encode(), b"long" * 60 + b" word", b"good words here good words", b"### $$$ *** ###"]


def test_features_and_scores_against_brute_force():
    rng = np.random.default_rng(3)
    table = rng.normal(0, 1, 1 << 10).astype(np.float32)
    for raw in TEXTS:
        assert sorted(quality_model.features(raw, 10).tolist()) == sorted(slow.subword_features(raw, 10))
        assert quality_model.score(raw, table, 0.3) == pytest.approx(slow.score(raw, table, 0.3), rel=1e-5)


def test_training_against_brute_force():
    examples = [(t, k % 2) for k, t in enumerate(TEXTS[1:])]
    table, bias = quality_model.train(examples, 8, 3, 4, 1.0, 5)
    rng = np.random.default_rng(5)
    vectors, layer = rng.uniform(-1 / 3, 1 / 3, (256, 3)).astype(np.float32).tolist(), rng.uniform(-0.5, 0.5, (2, 3)).astype(np.float32).tolist()
    want, want_bias = slow.train(examples, vectors, layer, [rng.permutation(len(examples)).tolist() for _ in range(4)], 1.0, 8)
    assert bias == pytest.approx(want_bias) and np.allclose(table, want, rtol=1e-3, atol=1e-4)


def test_query_of_quality_against_brute_force(spark, odd_docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(13)], "doc_id long, quality int")
    table, bias = quality_model.fit(odd_docs, labels)
    got = sorted((str(r.doc_id), r.held_out, r.predicted, r.score) for r in quality_model.apply_model(odd_docs, (table, bias)).collect())
    rows = odd_docs.collect()
    scores = [slow.score((r.text or "").encode(), table, bias) for r in rows]
    want = sorted((str(r.doc_id), r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0, int(s >= 0.3), s) for r, s in zip(rows, scores, strict=True))
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[3] == pytest.approx(b[3], rel=1e-4) and (a[2] == b[2] or abs(b[3] - 0.3) < 1e-4)


def test_query_of_toxicity_against_brute_force(spark, data):
    """Weights, cosines, neighbours, votes and the curve of every text from their definitions; nothing is taken from the index under test."""
    import math
    from collections import Counter

    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    marked = [(r.doc_id, r.toxic) for r in labels.collect() if r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    learned = sorted({(i, y) for i, y in marked if i in texts})
    found = {i: re.findall(r"\w+", texts[i].lower()) for i in texts}
    count = {i: Counter([*of, *(w[:n] + "*" for n in (3, 4) for w in of if len(w) > n)]) for i, of in found.items()}
    having = Counter(w for i, _ in learned for w in count[i])

    def vector(c):
        v = {w: (1 + math.log(n)) * math.sqrt(1 + math.log((1 + len(learned)) / (1 + having[w]))) for w, n in c.items() if having[w]}
        length = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / length for w, x in v.items()}

    vectors = {i: vector(count[i]) for i in texts}
    examples = [(i, y) for i, y in learned if vectors[i]]
    n1 = sum(y for _, y in marked)
    prior, share, reach = (n1 + 1) / (len(marked) + 2), sum(y for _, y in examples) / len(examples), max(16, math.isqrt(len(examples)))

    def nearest(i, but=None):
        cosines = sorted((-round(sum(x * vectors[e].get(w, 0.0) for w, x in vectors[i].items()), 12), k) for k, (e, _) in enumerate(examples) if k != but)[:reach]
        return [(-c, k) for c, k in cosines if c < 0]

    def shares(cosines):
        votes = [(c / (0.05 + 1 - min(1.0, c)), examples[k][1]) for c, k in cosines]
        return [sum(v * y for v, y in votes[:k]) / sum(v for v, _ in votes[:k]) if votes else share for k in (3, 8, 16, None)]

    # the curve: the least weighted log loss, with a small penalty on slopes of standardised votes, by plain descent
    x = np.array([shares(nearest(i, k)) for k, (i, _) in enumerate(examples)])
    y = np.array([float(z) for _, z in examples])
    weight = np.where(y == 1, n1 / share, (len(marked) - n1) / (1 - share)) / len(marked)
    middle, spread = x.mean(0), x.std(0) + 1e-9
    z = np.hstack((np.ones((len(x), 1)), (x - middle) / spread))
    b, penalty = np.zeros(5), np.array([1e-3, 1, 1, 1, 1])
    step = 1 / (0.25 * np.linalg.norm(z * np.sqrt(weight)[:, None], 2) ** 2 + 1)
    back = b
    for k in range(20_000):
        ahead = b + k / (k + 3) * (b - back)
        back, b = b, ahead - step * (z.T @ (weight * (1 / (1 + np.exp(-(z @ ahead))) - y)) + penalty * ahead)
    got = {r.doc_id: r for r in toxicity.apply_index(docs, toxicity.fit(docs, labels)).collect()}
    assert set(got) == set(texts)
    for i in texts:
        cosines = nearest(i)
        v = (np.array(shares(cosines)) - middle) / spread
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-(b[0] + b[1:] @ v))) if cosines else prior, rel=1e-4, abs=1e-6)
        assert got[i].similarity == pytest.approx(cosines[0][0] if cosines else 0, abs=1e-9)


def test_held_out_labels_change_no_score_of_toxicity(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(common.fold(F.col("doc_id"), 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert turned.exceptAll(labels).count() > 0
    first, second = (sorted((r.doc_id, r.score) for r in toxicity.apply_index(docs, toxicity.fit(docs, x)).collect()) for x in (labels, turned))
    assert first == second


def test_labels_of_absent_documents_and_long_texts_leave_a_sample(spark):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(5000)], "doc_id long, quality int")
    usable = lambda doc_id: doc_id >= 0
    assert common.labelled(docs, labels, "quality", usable, 20).count() == 20
    assert common.labelled(docs, labels, "quality", usable, 20, 4500).count() == 4
    assert common.labelled(docs, labels, "quality", usable, 20, 10).count() == 1


def test_toxicity_opens_an_index_once_and_meets_blocks_with_many_texts():
    """Long and short lists of postings, numbers above one, common terms and unknown words against cosines from their definitions; the work of a group of texts is shared."""
    rng = np.random.default_rng(7)
    make = lambda: " ".join(f"w{k}" for k in np.minimum(rng.zipf(1.3, 80), 4000)) + f" only{rng.integers(9)}"
    examples = [(i, make(), i % 2) for i in range(1400)]
    packed = common.zstandard.compress(toxicity.pickle.dumps(toxicity.NearestExamples(examples)))
    index = toxicity.opened(packed)
    assert toxicity.opened(packed) is index
    having = np.diff(index.start)
    assert having[0] > len(examples) / toxicity.COMMON and (np.diff(having) <= 0).all() and having[index.n_common] > toxicity.LONG > having[-1] and index.number.max() > 2
    dense = np.zeros((len(index.ids), len(having)))
    dense[index.at, np.repeat(np.arange(len(having)), having)] = index.weight
    texts = [make() + " w3 w3 unseen onlyx" for _ in range(300)]
    vectors, calls = [index._weights(t) for t in texts], []
    search = index._search
    index._search = lambda *x: calls.append(x[0].shape[0]) or search(*x)
    for (at, cosine), (terms, weights) in zip(index._nearest(vectors, 30), vectors, strict=True):
        scores = dense[:, terms] @ weights
        want = np.lexsort((np.arange(len(scores)), -np.round(scores, 12)))[:30]
        assert at.tolist() == want.tolist() and np.allclose(cosine, scores[want], atol=1e-12)
    assert calls == [300, 300]  # the first blocks of all texts, then what else can hold one of the nearest
