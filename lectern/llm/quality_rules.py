"""Quality rules: counted measures of a text, and its divergence from references of its languages.

A document's histogram of character classes and its histogram of common words are held against references by the
Jensen-Shannon distance (base 2, so from 0 to 1). The references are sums of shares over all documents of at least MIN_WORDS
words that the base rules keep and that use common words, by language; a document's language is the one whose common words it uses most, and each document
counts alike. A document fails if its nearest
reference, or a blend of them for texts in several languages, is farther in either distance than a limit that falls with the number of words, as short texts scatter more; both
distances are to the same reference, the one whose worse distance is the least part of its limit. Texts below
MIN_WORDS are never judged by divergence. The limits leave clean prose of every length a margin.

Results: a null or empty text has no words, so it fails the base rules. Rows with equal ids or texts are judged each
for itself. If no document can serve as reference, the base rules decide alone. Other columns are ignored.
Whole texts are measured, however long. Of references equally near the first language counts, and a share or distance at its limit passes. An empty table gives an empty one. Texts in a
language without common words here (LANGUAGES has those that are known) are measured against references of others, so prose in them may be rejected.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, prepare

# Very common words of the languages that have a reference.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über",
    "en": "the of and to a in is that for it as was with be by on not he his but at are this have from or had an they which you one we all her she there would their what",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux mais ou comme cette on ces nous leur lui tout être",
}

#: A text of fewer words is not judged by divergence.
MIN_WORDS = 50

#: Limits of the two distances: the first number plus the second over the square root of the number of words.
CLASS_LIMIT, WORD_LIMIT = (0.11, 1.8), (0.165, 2.1)

#: Parts of a document's shares in a reference.
UNITS = 1 << 24

SYMBOLS = b"#*$%&|<>"
CLASSES = 7


def _class_table() -> np.ndarray:
    """By byte: 0 a-z, 1 A-Z, 2 digits, 3 white space, 4 symbols, 5 other ASCII, 6 part of a longer character."""
    table = np.full(256, 6)
    table[:128] = 5
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", SYMBOLS)):
        table[list(chars)] = k
    return table


CLASS_OF = _class_table()
LANGUAGES = list(COMMON)
VOCABULARY = sorted({w.encode() for words in COMMON.values() for w in words.split()})
BIN_OF = {w: k for k, w in enumerate(VOCABULARY)}
MEMBER = np.array([[w in {x.encode() for x in COMMON[lang].split()} for w in VOCABULARY] for lang in LANGUAGES], float)


def histograms(raw: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of words, the counts of character classes and of common words; the last bin has all other words."""
    found = raw.lower().split()
    classes = np.bincount(CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=CLASSES).astype(float)
    common = np.zeros(len(VOCABULARY) + 1)
    for w, n in Counter(filter(BIN_OF.__contains__, found)).items():
        common[BIN_OF[w]] = n
    common[-1] = len(found) - common.sum()
    return len(found), classes, common


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    divergence = sum(0.5 * float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum()) for x in (p, q))
    return max(0.0, divergence) ** 0.5


def measures(raw: bytes, n_points: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text of n_points code points."""
    found = raw.split()
    n = len(found)
    spaces = len(raw) - sum(map(len, found))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(found, found[1:], found[2:], strict=False))
    repeats = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        inside = np.zeros(n, bool)
        at = np.flatnonzero(np.fromiter((times[w] > 1 for w in windows), bool, len(windows)))
        for k in range(3):
            inside[at + k] = True
        repeats = int(inside.sum())
    return n, n_points - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats


def base_failed(n: int, repeat: int) -> bool:
    """Whether a text of n words, repeat of them in repeated windows, fails the rules that need no reference."""
    return n < 50 or 100 * repeat > 50 * n


def references(docs: DataFrame, min_words: int = MIN_WORDS, clean: bool | None = None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By language: summed histograms over all documents of enough words. What reaches the driver is one small histogram a language.

    If clean, texts that fail the base rules or have no common word stay out, and each of the others adds its shares, in whole units of
    1 / UNITS so that sums don't depend on order. Else each adds its counts. By default clean, unless min_words asks for texts that the base rules reject.
    """
    clean = min_words >= MIN_WORDS if clean is None else clean
    prepare(docs.sparkSession)
    width = CLASSES + len(VOCABULARY) + 1

    def run(batches):
        sums = np.zeros((len(LANGUAGES), width))
        for batch in batches:
            for text in batch.column(0).to_pylist():
                raw = (text or "").encode()
                n, classes, common = histograms(raw)
                if n >= min_words:
                    hits = MEMBER @ common[:-1]
                    if clean:
                        if not hits.any() or base_failed(n, measures(raw, 0)[4]):
                            continue
                        classes, common = (np.round(x / x.sum() * UNITS) for x in (classes, common))
                    sums[int(hits.argmax())] += np.concatenate((classes, common))
        k, at = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"lang": k, "bin": at, "n": sums[k, at].astype(np.int64)}, schema=arrow_schema("lang int, bin int, n long"))

    rows = docs.select("text").mapInArrow(run, "lang int, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros((len(LANGUAGES), width))
    for lang, at, n in rows:
        sums[lang, at] = n
    return {lang: (sums[k, :CLASSES], sums[k, CLASSES:]) for k, lang in enumerate(LANGUAGES) if sums[k].sum()}


def blended(common: np.ndarray, refs: dict) -> tuple[np.ndarray, np.ndarray]:
    """The reference of a text in several languages: theirs, weighted by the common words that the text has of each."""
    langs = list(refs)
    weights = MEMBER[[LANGUAGES.index(x) for x in langs]] @ common[:-1] + 1e-9
    weights /= weights.sum()
    return tuple(sum(w * refs[x][k] / refs[x][k].sum() for w, x in zip(weights, langs, strict=True)) for k in (0, 1))


def divergent(n: int, classes: np.ndarray, common: np.ndarray, refs: dict, min_words: int = MIN_WORDS) -> tuple[bool, float, float]:
    """Whether a text is too far from every reference, and its distances to the nearest one."""
    if n < min_words or not refs:
        return False, 0.0, 0.0
    near = [*refs.values(), blended(common, refs)]
    class_limit, word_limit = (a + b / n**0.5 for a, b in (CLASS_LIMIT, WORD_LIMIT))
    by_class, by_word = min(((distance(classes, a), distance(common, b)) for a, b in near), key=lambda d: max(d[0] / class_limit, d[1] / word_limit))
    return by_class > class_limit or by_word > word_limit, by_class, by_word


RULED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def apply_rules(docs: DataFrame, refs: dict | None = None) -> DataFrame:
    """For each document the measures and the verdict; refs are learned from docs themselves if none are given."""
    prepare(docs.sparkSession)
    refs = references(docs, clean=True) if refs is None else refs

    def run(batches):
        schema = arrow_schema(RULED)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                n, chars, symbols, dup, repeat = measures(raw, len(text or ""))
                failed = base_failed(n, repeat)
                far, by_class, by_word = divergent(*histograms(raw), refs)
                out.append((doc_id, n, chars, symbols, dup, repeat, failed, not failed and not far, by_class, by_word))
            yield _batch(out, schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, RULED)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, in one pass over the rows themselves: all columns travel through, nothing is joined."""
    prepare(docs.sparkSession)
    refs = references(docs, clean=True)

    def run(batches):
        for batch in batches:
            verdicts = []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                n, _, _, _, repeat = measures(raw, 0)
                verdicts.append(not base_failed(n, repeat) and not divergent(*histograms(raw), refs)[0])
            yield batch.filter(pa.array(verdicts, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
