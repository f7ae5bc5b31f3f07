import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import language_id as lid
from lectern.llm import queries

SAMPLES = {
    "en": "the house stands near the river and the children walk to school every morning with their friends",
    "de": "das haus steht nahe am fluss und die kinder gehen jeden morgen mit ihren freunden zur schule über die brücke",
    "it": "la casa si trova vicino al fiume e i bambini vanno a scuola ogni mattina con i loro amici perché è bello",
    "ru": "дом стоит у реки и дети каждое утро идут в школу со своими друзьями",
    "uk": "будинок стоїть біля річки і діти щоранку йдуть до школи зі своїми друзями її",
    "el": "το σπίτι βρίσκεται κοντά στο ποτάμι και τα παιδιά πηγαίνουν σχολείο κάθε πρωί",
    "ja": "家は川の近くにあります そして子供たちは毎朝友達と学校に歩いて行きます",
}


def training(times=30):
    rng = np.random.default_rng(1)
    return [(lang, " ".join(rng.permutation(text.split()))) for lang, text in SAMPLES.items() for _ in range(times)]


@pytest.fixture(scope="module")
def model(spark):
    return lid.fit(spark.createDataFrame([(4 * k, t, x) for k, (x, t) in enumerate(training())], "doc_id long, text string, lang string"), usable=lambda i: i >= 0)


def slow_labels(e, switch):
    """Viterbi from its definition, one word after the other."""
    best = [(float(x), (k,)) for k, x in enumerate(e[0])]
    for row in e[1:]:
        best = [max((best[j][0] - (switch if j != k else 0) + float(x), best[j][1] + (k,)) for j in range(len(row))) for k, x in enumerate(row)]
    return max(best)[0]


def value(e, path, switch):
    return sum(float(e[t][k]) for t, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:], strict=False))


@pytest.mark.parametrize("switch", [0.5, 4.0, 12.0])
def test_labels_are_the_best_ones(switch):
    rng = np.random.default_rng(7)
    texts = []
    for n in [1, 1, 2, 3, 5, 17, 40, 90] * 6:
        e = np.cumsum(rng.normal(0, 1, (n, 4)), axis=0) * rng.choice([0.02, 0.3, 3.0])
        texts.append((e - e.max(1)[:, None]).astype(np.float32))
    for e, path in zip(texts, lid.labels(texts, switch), strict=True):
        assert len(path) == len(e) and value(e, path.tolist(), switch) == pytest.approx(slow_labels(e, switch), abs=1e-4)


def slow_scores(model_rows, words):
    """Shares of words and n-grams per language, from strings, without a hash."""
    grams = lambda w: [(n, f" {w} "[i : i + n]) for n in lid.GRAMS for i in range(len(w) + 3 - n) if n > 1 or f" {w} "[i] != " "]
    langs = sorted({x for x, _ in model_rows})
    counts = {x: Counter() for x in langs}
    for lang, text in model_rows:
        for w in re.findall(r"[^\W\d_]+", text):
            w = unicodedata.normalize("NFC", w.lower())
            counts[lang].update(grams(w))
            counts[lang][w] += 1
    out = []
    for w in words:
        log = lambda x, g: np.log(counts[x][g] / sum(counts[x].values()) + lid.FLOOR / lid.REFERENCE)
        out.append([log(x, w) + sum(log(x, g) for g in grams(w)) / len(lid.GRAMS) for x in langs])
    return np.array(out)


def test_scores_against_counts_of_strings(spark):
    rows = [r for r in training(3) if r[0] in ("en", "de", "it")]
    model = lid.fit(spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate(rows)], "doc_id long, text string, lang string"), usable=lambda i: i >= 0)
    words = ["the", "schule", "bello", "brücke", "a", "xyz", "mattina"]
    scorer = lid.Scorer(model)
    scorer.numbered([words])
    right = slow_scores(rows, words)
    got = scorer.score[: len(words)]
    assert np.abs(got - (right - right.max(1)[:, None])).max() < 0.35  # few of 262,144 buckets are shared


def test_mixed_texts_have_spans(spark, model):
    parts = [("de", SAMPLES["de"]), ("en", SAMPLES["en"]), ("el", SAMPLES["el"]), ("ru", SAMPLES["ru"]), ("ja", SAMPLES["ja"])]
    text = "12. " + " -- ".join(t for _, t in parts) + " 99"
    docs = spark.createDataFrame([(1, text), (2, "12 34"), (3, None), (4, SAMPLES["it"])], "doc_id long, text string")
    found = [tuple(r) for r in lid.spans(docs, model).orderBy("doc_id", "start").collect()]
    assert [r[3] for r in found] == [x for x, _ in parts] + ["it"]
    assert [text[r[1] : r[2]] for r in found[:-1]] == [t for _, t in parts]
    rows = {r.doc_id: r for r in lid.predict(docs, model).collect()}
    assert rows[1].n_spans == 5 and 0.1 < rows[1].score < 0.5 and rows[4].lang_pred == "it" and rows[4].score > 0.99
    assert [(rows[k].lang_pred, rows[k].score, rows[k].n_spans) for k in (2, 3)] == [("und", 0.0, 0)] * 2


def test_scripts_narrow_the_languages(model):
    scorer = lid.Scorer(model)
    at = scorer.numbered([["и", "x", "και", "家", "ไทย", "їжак"]])[0]
    open_to = [{x for x, s in zip(model.langs, scorer.score[k], strict=True) if s > -1e4} for k in at.tolist()]
    assert open_to == [{"ru", "uk"}, {"de", "en", "it"}, {"el"}, {"ja"}, set(model.langs), {"ru", "uk"}]


def test_odd_rows(spark, odd_docs, no_docs, model):
    rows = lid.predict(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred == "und") == (r.n_spans == 0) for r in rows) and {r.lang_pred for r in rows} <= {"und", *model.langs}
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert {r.held_out for r in rows if r.doc_id == 3} == {zlib.crc32(b"3") % 4 == 2}
    assert lid.predict(no_docs, model).collect() == [] and lid.spans(no_docs, model).collect() == []
    assert lid.fit(no_docs) is None and {r.lang_pred for r in lid.predict(odd_docs, None).collect()} == {"und"} and lid.spans(odd_docs, None).collect() == []
    assert lid.fit(odd_docs).langs == ["en"]


def test_held_out_labels_teach_nothing(spark):
    rows = [(k, t, x) for k, (x, t) in enumerate(training(8))]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    turned = [(k, t, "xx" if held(k) else x) for k, t, x in rows]
    first, second = (lid.fit(spark.createDataFrame(r, "doc_id long, text string, lang string")) for r in (rows, turned))
    assert first.langs == second.langs and (first.table == second.table).all()


def test_words_are_forgotten_when_there_are_too_many(model):
    scorer = lid.Scorer(model)
    scorer.most = 5
    for _ in range(3):
        words = [SAMPLES["en"].split(), SAMPLES["it"].split()]
        assert [x[0] for x in lid.judged(scorer, [" ".join(w) for w in words])] == ["en", "it"]
    assert len(scorer.at) == len(scorer.score) == len(scorer.letters)


def test_very_long_words_and_texts(spark, model):
    docs = spark.createDataFrame([(1, "schule" * 5000), (2, (SAMPLES["de"] + " ") * 3000 + (SAMPLES["en"] + " ") * 2000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in lid.predict(docs, model).collect()}
    assert rows[1].lang_pred == "de" and rows[2].lang_pred == "de" and rows[2].n_spans == 2 and 0.55 < rows[2].score < 0.7


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op11_language_id(spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.98 * len(rows) > 200
