import re
from collections import Counter

import numpy as np
import pytest

from lectern.llm import quality_rules as qr

from . import slow as plain

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_measures_against_brute_force(spark, odd_docs, no_docs, data):
    docs = odd_docs.select("doc_id", "text").union(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"))
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in qr.apply_rules(docs).collect())
    want = []
    for r in docs.collect():
        m = slow(r.text)
        want.append((str(r.doc_id), *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert got == sorted(want)
    assert all(r.kept is False for r in qr.apply_rules(docs).filter("base_failed").collect())
    assert qr.apply_rules(no_docs).collect() == []


def test_clean_documents_stay_and_junk_goes(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = qr.apply_rules(docs).join(labels, "doc_id").filter("not base_failed").collect()
    clean = [r.kept for r in judged if r.quality == 1]
    junk = [r.kept for r in judged if r.quality == 0]
    assert np.mean(clean) >= 0.99 and np.mean(junk) <= 0.35 and len(clean) > 100


def test_references_count_all_documents(spark, odd_docs):
    refs = qr.references(odd_docs, min_words=1)
    total = sum(a.sum() for a, _ in refs.values())
    assert total == sum(len(r.text.encode()) for r in odd_docs.collect() if r.text and r.text.split())
    assert qr.references(odd_docs.limit(0)) == {}


def test_distance():
    p, q = np.array([1.0, 0, 0]), np.array([0.0, 2, 0])
    assert qr.distance(p, q) == pytest.approx(1) and qr.distance(p, 3 * p) == 0 and qr.distance(p, np.zeros(3)) == 0
    assert qr.distance(np.array([1.0, 1]), np.array([1.0, 3])) == pytest.approx(qr.distance(np.array([1.0, 3]), np.array([1.0, 1])))


def test_keep_good_keeps_whole_rows(odd_docs):
    kept = qr.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    want = sorted(str(r.doc_id) for r in qr.apply_rules(odd_docs).filter("kept").collect())
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_a_text_in_two_languages_is_near_the_blend_of_both(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    refs = qr.references(docs)
    clean = docs.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1 AND toxic = 0"), "doc_id")
    by = {lang: " ".join(r.text for r in clean.filter(f"lang = '{lang}'").orderBy("doc_id").limit(5).collect()) for lang in ("en", "fr")}
    mixed = (by["en"][:4000] + " " + by["fr"][:4000]).encode()
    n, classes, common = qr.histograms(mixed)
    far, by_class, by_word = qr.divergent(n, classes, common, refs)
    assert not far and by_word < min(qr.distance(common, b) for _, b in refs.values())


def test_junk_and_long_texts_do_not_rule_a_reference(spark):
    prose = " ".join(f"der {w}{k} die und {w}b{k} nicht x{k}" for k, w in enumerate("haus baum weg tal see".split() * 4))
    junk = " ".join(f"|{k}" for k in range(3000))
    repeated = "der die das " * 4000
    both = " ".join(f"{w}{k} und" for k in range(4000) for w in "ABC")
    clean = qr.references(spark.createDataFrame([(prose,)], "text string"), clean=True)
    refs = qr.references(spark.createDataFrame([(prose,), (junk,), (repeated,)], "text string"), clean=True)
    assert list(refs) == ["de"] and all(np.array_equal(a, b) for a, b in zip(refs["de"], clean["de"], strict=True))
    long = qr.references(spark.createDataFrame([(prose,), (both,)], "text string"), clean=True)["de"][0]
    assert long.sum() == pytest.approx(2 * clean["de"][0].sum(), rel=1e-5)
    judged = qr.apply_rules(spark.createDataFrame([(1, prose), (2, junk)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.kept for r in judged} == {1: True, 2: False}


def test_both_distances_are_to_the_same_reference():
    classes, common = np.eye(qr.CLASSES), np.eye(len(qr.VOCABULARY) + 1)
    refs = {"de": (classes[0], common[0]), "en": (classes[1], common[-1])}
    far, by_class, by_word = qr.divergent(10000, classes[0], common[-1], refs)
    assert far and max(by_class, by_word) > 0.5


def test_verdicts_against_brute_force(spark, odd_docs, data):
    docs = odd_docs.select("doc_id", "text").union(spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    rows = docs.collect()
    common = {lang: words.split() for lang, words in qr.COMMON.items()}
    refs = plain.references([r.text or "" for r in rows], common, qr.UNITS)
    want = sorted((str(r.doc_id), plain.kept(r.text or "", refs, common, qr.CLASS_LIMIT, qr.WORD_LIMIT)) for r in rows)
    got = sorted((str(r.doc_id), r.kept) for r in qr.apply_rules(docs).collect())
    assert got == want and {k for _, k in want} == {True, False} and len(refs) > 1
