"""Language identification that labels the spans of mixed-language texts.

A word is a run of letters and marks; the ranges of its script narrow the languages to those that write in that script in the training texts. Each of these scores the word by the logarithms of
its shares of the word and of its character n-grams (1 to 4, with the word's ends), hashed into one table. Viterbi finds the labels of a text's words whose scores, less a penalty for each
switch between neighbours, add up to the most. The text's language is the one whose spans hold the most letters.

Most texts need no search: if no stretch of words favours another language over the best one by more than half a penalty, no labelling with switches can be better, since each of
its other stretches costs at least as much as it brings. The rest of a batch goes through Viterbi together, word by word.

What is learned from is about SAMPLE_BYTES of text a language, chosen by a hash of id and text, or all there is; shares are counted by Spark, and the table is as large as CELLS allows for
the languages that there are, so what is broadcast is bounded by that and by the number of languages. Unseen n-grams score alike in all languages, however much text each had. No label, source or id is an input of a prediction.

Results: one row for every row of docs. `und` with score 0 for a text that is null, empty or without letters. If nothing can be learned from (an empty table, no language, no
text), every text is `und`. The score is the share of the text's letters in spans of its language, times the probability of that language by the words of these spans. Of languages with equal letters
the first by name wins; a text in a script that no language writes is labelled by the same rule. Whole texts are read; words longer than LONGEST letters are cut into pieces. Rows with a null or repeated id are predicted each for itself; a null id is not held out, and such rows
teach nothing. Other columns are not looked at.
"""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, fold, prepare

#: Bytes of text learned from in each language, about; cells of the table, buckets times languages, and its least buckets by power of two.
SAMPLE_BYTES, CELLS, LEAST_LOG2 = 8 << 20, 1 << 21, 14

#: Tasks that count n-grams, letters in a word, n-grams, and the floor under shares: what so many occurrences in REFERENCE would be.
TASKS, LONGEST, GRAMS, FLOOR, REFERENCE = 8, 48, (1, 2, 3, 4), 0.5, 5e6

#: What a switch between neighbouring words costs, in natural logarithms, and the share of its letters that makes a script one of a language.
SWITCH, WRITES = 12.0, 0.005

#: Bytes for remembered words in a worker.
MEMO_BYTES = 64 << 20

#: Ranges of scripts, by first and last code point (fixed values). What lies between belongs to one further script.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x0250, 0x02AF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("syriac", 0x0700, 0x074F),
    ("arabic", 0x0750, 0x077F), ("thaana", 0x0780, 0x07BF), ("nko", 0x07C0, 0x07FF), ("arabic", 0x08A0, 0x08FF), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF),
    ("oriya", 0x0B00, 0x0B7F), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF),
    ("tibetan", 0x0F00, 0x0FFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x139F), ("cherokee", 0x13A0, 0x13FF), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("georgian", 0x2D00, 0x2D2F), ("cyrillic", 0x2DE0, 0x2DFF), ("kana", 0x3040, 0x30FF), ("hangul", 0x3130, 0x318F), ("kana", 0x31F0, 0x31FF), ("han", 0x3400, 0x9FFF),
    ("cyrillic", 0xA640, 0xA69F), ("latin", 0xA720, 0xA7FF), ("hangul", 0xAC00, 0xD7FF), ("han", 0xF900, 0xFAFF), ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFE), ("latin", 0xFF21, 0xFF5A), ("kana", 0xFF66, 0xFF9F), ("han", 0x20000, 0x3FFFF),
]
NAMES = [*dict.fromkeys(name for name, _, _ in SCRIPTS), "other"]
_EDGES = np.array([x for _, a, b in SCRIPTS for x in (a, b + 1)])
_SIDES = np.array([len(NAMES) - 1] + [x for name, _, _ in SCRIPTS for x in (NAMES.index(name), len(NAMES) - 1)])

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]{0,%d}" % (LONGEST - 1))
ASCII_WORD = regex.compile(r"[A-Za-z]{1,%d}" % LONGEST)


class Model(NamedTuple):
    langs: list[str]
    table: np.ndarray  # logarithms of shares, buckets x languages
    writes: np.ndarray  # scripts x languages


def word_features(words: list[str], log2: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Of distinct words: (word, bucket) arrays of each kind of feature, words ascending; which scripts each has; its letters. A pair of arrays for each n, then one for whole words."""
    folded = [unicodedata.normalize("NFC", w.lower()) or w for w in words]
    chars = np.frombuffer(f" {' '.join(folded)} ".encode("utf-32-le"), np.uint32)
    gap = chars == 32
    of = np.cumsum(gap) - 1  # a gap counts to the word behind it
    shift = np.uint32(32 - log2)
    out, h = [], np.zeros(len(chars) + 1, np.uint32)
    for n in range(1, max(GRAMS) + 1):
        h = h[:-1] * np.uint32(0x01000193) + (chars[n - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
        within = ~gap[: len(h)] if n == 1 else np.ones(len(h), bool)
        for k in range(1, n - 1):  # a gap may stand at either end
            within &= ~gap[k : k + len(h)]
        at = np.flatnonzero(within)
        if n == 2:
            at = at[~(gap[at] & gap[at + 1])]
        out.append((of[at], ((h[at] + np.uint32(n)) * np.uint32(0x85EBCA6B) >> shift).astype(np.int64)))
    # a word's hash: the sum of its letters' hashes, each with its place
    begin = np.flatnonzero(gap[:-1]) + 1
    place = np.arange(len(chars) - 1) - np.repeat(begin, np.diff(np.append(begin, len(chars)))) if len(begin) else np.empty(0)
    mixed = (chars[1:] * np.uint32(0x27D4EB2F)) ^ ((place + 2).astype(np.uint32) * np.uint32(0xC2B2AE35))
    mixed = np.where(gap[1:], np.uint32(0), mixed * np.uint32(0x9E3779B1) + (mixed >> np.uint32(15)))
    whole = np.add.reduceat(mixed, begin - 1, dtype=np.uint32) if len(begin) else np.empty(0, np.uint32)
    out.append((np.arange(len(words)), ((whole ^ (whole >> np.uint32(13))) * np.uint32(0x85EBCA6B) >> shift).astype(np.int64)))
    letters = np.flatnonzero(~gap)
    scripts = np.zeros((len(words), len(NAMES)), np.int32)
    np.add.at(scripts, (of[letters], _SIDES[np.searchsorted(_EDGES, chars[letters], "right")]), 1)
    return out, scripts, scripts.sum(1)


def found_words(text: str) -> list[str]:
    return (ASCII_WORD if text.isascii() else WORD).findall(text)


def log2_for(languages: int) -> int:
    """The table's buckets for so many languages, by power of two."""
    return max(LEAST_LOG2, min(18, (CELLS // max(1, languages)).bit_length() - 1))


def fit(docs: DataFrame, usable=lambda doc_id: fold(doc_id, 4) != 2, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """A model of the languages in docs (doc_id, text, lang), from the rows whose id is usable."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter("text is not null and lang is not null").filter(usable(F.col("doc_id")))
    # a row a language
    sizes = sorted((r.lang, r.n) for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect() if r.n)
    if not sizes:
        return None
    langs = [x for x, _ in sizes]
    log2 = log2_for(len(langs))
    share = spark.createDataFrame([(x, no, min(1.0, sample_bytes / n)) for no, (x, n) in enumerate(sizes)], "lang string, lang_no int, share double")
    chosen = rows.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang_no", "text").repartition(TASKS)

    def run(batches):
        schema = arrow_schema("lang_no int, bucket int, n long")
        grams, scripts = np.zeros((len(langs), 1 << log2), np.int64), np.zeros((len(langs), len(NAMES)), np.int64)
        for batch in batches:
            for no in np.unique(numbers := batch.column(0).to_numpy()).tolist():
                seen: dict[str, int] = {}
                for text in batch.column(1).filter(pa.array(numbers == no)).to_pylist():
                    for w in found_words(text):
                        seen[w] = seen.get(w, 0) + 1
                if seen:
                    times = np.fromiter(seen.values(), np.int64, len(seen))
                    kinds, of_script, _ = word_features([*seen], log2)
                    for word, bucket in kinds:
                        grams[no] += np.bincount(bucket, times[word], 1 << log2).astype(np.int64)
                    scripts[no] += times @ of_script
        for no in range(len(langs)):
            at, s = np.flatnonzero(grams[no]), np.flatnonzero(scripts[no])
            buckets, n = np.append(at, -1 - s), np.append(grams[no][at], scripts[no][s])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), no, np.int32)), pa.array(buckets.astype(np.int32)), pa.array(n)], schema=schema)

    counted = chosen.mapInArrow(run, "lang_no int, bucket int, n long").groupBy("lang_no", "bucket").agg(F.sum("n").alias("n")).toArrow()
    no, bucket, n = (counted.column(k).to_numpy() for k in range(3))
    table, scripts = np.zeros((1 << log2, len(langs))), np.zeros((len(NAMES), len(langs)))
    gram = bucket >= 0
    table[bucket[gram], no[gram]] = n[gram]
    scripts[-1 - bucket[~gram], no[~gram]] = n[~gram]
    shares = table / np.maximum(1, table.sum(0))
    return Model(langs, np.log(shares + FLOOR / REFERENCE).astype(np.float32), scripts >= np.maximum(1, WRITES * scripts.sum(0)))


class Scorer:
    """Scores words by a model and remembers them."""

    def __init__(self, model: Model):
        self.model, self.log2 = model, len(model.table).bit_length() - 1
        self.most = max(1000, MEMO_BYTES // (4 * len(model.langs) + 150))
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.score, self.letters = np.empty((0, len(self.model.langs)), np.float32), np.empty(0, np.int64)

    def numbered(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The numbers of each text's words; words not met before are scored."""
        if len(self.at) > self.most:
            self.forget()
        at, old = self.at, len(self.at)
        out = [np.fromiter((at.setdefault(w, len(at)) for w in words), np.int64, len(words)) for words in texts]
        new = list(at)[old:]
        for k in range(0, len(new), 1 << 16):
            score, letters = self._scored(new[k : k + (1 << 16)])
            self.score, self.letters = np.concatenate([self.score, score]), np.append(self.letters, letters)
        return out

    def _scored(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' scores, from 0 for the best language down, and their letters."""
        kinds, scripts, letters = word_features(words, self.log2)
        score = np.zeros((len(words), len(self.model.langs)))
        for k, (word, bucket) in enumerate(kinds):
            sums = np.concatenate([np.zeros((1, score.shape[1])), np.cumsum(self.model.table[bucket], axis=0, dtype=np.float64)])
            edge = np.searchsorted(word, np.arange(len(words) + 1))
            score += (sums[edge[1:]] - sums[edge[:-1]]) * (1.0 if k == len(GRAMS) else 1 / len(GRAMS))
        # who writes in all of the word's scripts, or else anyone
        may = (scripts > 0).astype(np.int32) @ (~self.model.writes).astype(np.int32) == 0
        may |= ~may.any(1)[:, None]
        score[~may] = -np.inf
        score -= score.max(1)[:, None]
        return np.maximum(score, -1e4).astype(np.float32), letters


def labels(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best language number of each word, for each text's scores (words x languages, one word at least)."""
    out: list[np.ndarray | None] = []
    for e in scores:
        best = int(e.sum(0, dtype=np.float64).argmax())
        lead = np.cumsum(e - e[:, best : best + 1], axis=0, dtype=np.float64)
        before = np.minimum(np.minimum.accumulate(lead, axis=0), 0)
        before = np.concatenate([np.zeros((1, e.shape[1])), before[:-1]])
        out.append(np.full(len(e), best) if (lead - before).max(initial=0) <= switch / 2 - 1e-6 else None)
    left = sorted((k for k, x in enumerate(out) if x is None), key=lambda k: -len(scores[k]))
    if left:
        sizes = np.array([len(scores[k]) for k in left])
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")  # texts that have a t-th word
        v = np.stack([scores[k][0] for k in left]).astype(np.float64)
        came = []  # from which language each is reached at best
        stay = np.arange(v.shape[1])
        flat, starts = np.concatenate([scores[k] for k in left]), np.cumsum(sizes) - sizes
        for t in range(1, sizes[0]):
            n = int(active[t])
            now = v[:n]
            top = now.argmax(1)
            high = now[np.arange(n), top] - switch
            moved = high[:, None] > now
            came.append(np.where(moved, top[:, None], stay).astype(np.int32))
            v[:n] = np.where(moved, high[:, None], now) + flat[starts[:n] + t]
        state = v.argmax(1)
        path = [np.empty(s, np.int64) for s in sizes]
        for t in range(sizes[0] - 1, -1, -1):
            n = int(active[t])
            for j in range(n):
                path[j][t] = state[j]
            if t:
                state[:n] = came[t - 1][np.arange(n), state[:n]]
        for k, p in zip(left, path, strict=True):
            out[k] = p
    return out


def judged(scorer: Scorer, texts: list[str | None]) -> list[tuple[str, float, int]]:
    """Language, score and number of spans of each text."""
    words = [found_words(t) if t else [] for t in texts]
    numbers = scorer.numbered(words)
    held = [k for k, x in enumerate(numbers) if len(x)]
    out: list[tuple[str, float, int]] = [("und", 0.0, 0)] * len(texts)
    scores = [scorer.score[numbers[k]] for k in held]
    for k, e, label in zip(held, scores, labels(scores), strict=True):
        letters = np.bincount(label, scorer.letters[numbers[k]], e.shape[1])
        pred = int(letters.argmax())
        total = e[label == pred].sum(0, dtype=np.float64)
        sure = float(1 / np.exp(np.minimum(total - total[pred], 700)).sum())
        out[k] = scorer.model.langs[pred], min(1.0, sure * float(letters[pred] / letters.sum())), int((np.diff(label) != 0).sum()) + 1
    return out


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, n_spans int"


def portions(batch: pa.RecordBatch, column: int, most: int = 4 << 20):
    """Slices of a batch whose texts have about so many bytes together, a row at least."""
    sizes = np.array([0 if x is None else len(x) for x in batch.column(column).to_pylist()], np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def predict(docs: DataFrame, model: Model | None, held_out=lambda doc_id: fold(doc_id, 4) == 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans for every row of docs."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        schema, scorer = arrow_schema(PREDICTED), sent.value and Scorer(sent.value)
        for whole in batches:
            for batch in portions(whole, 1):
                rows = judged(scorer, batch.column(1).to_pylist()) if scorer else [("und", 0.0, 0)] * batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x, schema.field(k + 2).type) for k, x in enumerate(zip(*rows, strict=True)))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out(F.col("doc_id").cast("long")), F.lit(False)).alias("held_out")).mapInArrow(run, PREDICTED)


def spans(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, start, end, lang, a row for each span of every text: code points from a span's first letter up to behind its last. Texts without letters have none."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    ddl = "doc_id long, start int, end int, lang string"

    def run(batches):
        schema, scorer = arrow_schema(ddl), sent.value and Scorer(sent.value)
        for whole in batches if scorer else ():
            for batch in portions(whole, 1):
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if words := [*(ASCII_WORD if text.isascii() else WORD).finditer(text)] if text else []:
                        at = scorer.numbered([[w[0] for w in words]])[0]
                        label = labels([scorer.score[at]])[0]
                        cuts = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(words)]
                        rows += [(doc_id, words[a].start(), words[b - 1].end(), scorer.model.langs[label[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)
