"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are all words of a text, in lower case, and the beginnings of longer words, by which inflected and compound words meet; weighted by 1 + log of their number and
by a power of the smoothed inverse document frequency in the sample. The vocabulary is the whole
sample's. The power and the letters of beginnings were chosen by two-fold cross-validation among the rows that may be learned from, never by others. Every sampled example of both labels with a term is in the index: each term has its
examples in order of place, in blocks.
Terms of many examples (common ones) also lie in dense columns with the greatest weight in each block. A query's bound for a block is the greatest score there by
its rarer terms, which is exact, plus the sum of its common weights times these maxima; the blocks of the greatest bounds are searched first, then those that can still hold one of the k
nearest, which are exact; a block meets all queries of a group that search it at once. Neighbours vote with weights that rise as the distance falls. The votes of the few nearest, of more and of all of them become a score by a
logistic curve that is learned on the examples, each scored without itself, and weighted to the labels' true shares; the nearest examples' ids are the evidence.
Texts that share no term with an example score the share of label 1.

Learned from a bounded sample, in one task: of each label the rows with the smallest hash of their id, label 1 first up to half of SAMPLE, so that all
examples of a rare label are learned. The index that is broadcast is bounded by the sample's words. Only text is an input of a score; whole texts are read.

Results: a null text counts as empty. Without labelled rows every score is 0.5. Null labels teach nothing, a row labelled
twice teaches twice; equal similarities go to the smaller example id. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from functools import lru_cache, reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, fold, labelled, prepare

SAMPLE, BLOCK, NEAREST = 6000, 64, 16

#: The power of the inverse document frequency in a weight: rare words, most of a corpus, else outweigh in a text's length all that texts share.
POWER = 0.5

#: Letters of the beginnings of words that are terms beside the words.
BEGINNINGS = (3, 4)

#: Votes are counted among so many nearest examples, and among all that are sought.
FEW = (3, 8, NEAREST)

#: A term that at least one in so many examples has is common: its weights lie in a dense column.
COMMON = 8

#: So many texts are weighed at once.
GROUP = 256

#: The postings of a term of more examples are copied as a whole; those of others are picked one by one.
LONG = 64

_words = re.compile(r"\w+").findall


def terms(text: str) -> set[str]:
    """The words of a text and the beginnings of longer ones, marked by a star."""
    found = set(_words(text.lower()))
    return found.union(*({w[:n] + "*" for w in found if len(w) > n} for n in BEGINNINGS))


def _small(a: np.ndarray) -> np.ndarray:
    """Integers as the least kind that holds them."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n integers from each first one on, one after the other."""
    ends = np.cumsum(n)
    return np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


class Terms(dict):
    """The numbers of terms. A word that is none has the number of its longest beginning that is one, or else the number of terms."""

    def __missing__(self, word: str) -> int:
        for n in reversed(BEGINNINGS):
            if len(word) > n and (k := self.get(word[:n] + "*")) is not None:
                return k
        return len(self)


class NearestExamples:
    def __init__(self, examples: list[tuple[int, str, int]], of_labels: tuple[int, int] | None = None):
        """examples: (id, text, label), in any order; of_labels: the rows of label 0 and of label 1 that they were drawn from, if not all are here."""
        examples = sorted(examples, key=lambda e: (e[0], e[2], e[1]))
        having = Counter(w for _, text, _ in examples for w in terms(text))
        self._name(sorted(having, key=lambda w: (-having[w], w)))
        self.idf = np.array([(1 + math.log((1 + len(examples)) / (1 + having[w]))) ** POWER for w in self.term])
        rows = [(i, y, self._counts(text)) for i, text, y in examples]
        rows = [(i, y, (at, *self._lengthened(at, n)), n) for i, y, (at, n) in rows if len(at)]
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.labels = np.array([r[1] for r in rows], float)
        self.n_blocks = -(-len(rows) // BLOCK)
        of = np.concatenate([np.empty(0, np.int64), *(r[2][0] for r in rows)])
        at, number = np.repeat(np.arange(len(rows)), [len(r[2][0]) for r in rows]), np.concatenate([np.empty(0, np.int64), *(r[3] for r in rows)])
        order = np.lexsort((at, number, of))
        #: The postings of term k, by number and place: start[k] to start[k + 1].
        self.start = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(self.term)))))
        self.at, self.number = _small(at[order]), _small(number[order])
        self.length = np.array([r[2][2] for r in rows])
        self._open()
        n1 = sum(y for _, _, y in examples)
        n0, n1 = of_labels or (len(examples) - n1, n1)
        self.prior = (n1 + 1) / (n0 + n1 + 2)
        self.reach = max(NEAREST, math.isqrt(len(rows)))
        self._calibrate([r[2][:2] for r in rows], n0, n1)

    def _name(self, terms: list[str]) -> None:
        """The numbers of the terms, the most frequent first, so that what most texts ask for lies together, and of each the longest beginning that is another one: all that a word counts for is met by going back from its own number."""
        self.term = Terms(zip(terms, range(len(terms)), strict=True))
        self.back = np.array([*(self.term.__missing__(w.rstrip("*")) for w in terms), len(terms)], np.int64)

    @property
    def weight(self) -> np.ndarray:
        """The weight of each posting."""
        return (1 + np.log(self.number.astype(float))) * np.repeat(self.idf, self.having) / self.length[self.at]

    def _open(self) -> None:
        """The dense columns of common terms, their block maxima and what else follows from the postings; it does not travel."""
        self.having = np.diff(self.start)
        self.n_common, self.n_long = (int((self.having > n).sum()) for n in (len(self.ids) / COMMON, min(LONG, len(self.ids) / COMMON)))
        ends = self.start[: self.n_long + 1].tolist()
        self.long = [self.at[x:y] for x, y in pairwise(ends)]
        # runs of the same term and number, which weigh alike but for the examples' lengths: their first one of each term, their sizes and weights
        of = np.repeat(np.arange(len(self.having)), self.having)
        first = np.flatnonzero(np.diff(of, prepend=-1) | np.diff(self.number.astype(np.int64), prepend=-1))
        self.runs = np.searchsorted(of[first], np.arange(len(self.having) + 1))
        self.size, self.loudness = np.diff(first, append=len(of)), (1 + np.log(self.number[first].astype(float))) * self.idf[of[first]]
        weight = self.weight
        self.dense = np.zeros((self.n_blocks, BLOCK, self.n_common))
        for t, (x, y) in enumerate(pairwise(ends[: self.n_common + 1])):
            self.dense[self.at[x:y] // BLOCK, self.at[x:y] % BLOCK, t] = weight[x:y]
        self.most = self.dense.max(axis=1)

    def __getstate__(self):
        """Places and numbers as the least integers that hold them."""
        kept = {k: v for k, v in self.__dict__.items() if k not in ("having", "long", "runs", "size", "loudness", "dense", "most", "term", "back")}
        return kept | {"words": "\n".join(self.term)}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._name(self.__dict__.pop("words").split("\n") if len(self.idf) else [])
        self._open()

    @property
    def blocks(self) -> dict[int, tuple[np.ndarray, np.ndarray, dict]]:
        """By term: the blocks it occurs in, its greatest weight in each, and by block the places in it with their weights. For inspection."""
        out, all_at, all_weight = {}, self.at.astype(np.int64), self.weight
        for t in range(len(self.term)):
            at, w = (x[self.start[t] : self.start[t + 1]] for x in (all_at, all_weight))
            order = np.argsort(at)
            at, w = at[order], w[order]
            block, first = np.unique(at // BLOCK, return_index=True)
            ends = np.append(first[1:], len(at))
            out[t] = block, np.maximum.reduceat(w, first), {int(k): (at[a:b] % BLOCK, w[a:b]) for k, a, b in zip(block, first, ends, strict=True)}
        return out

    def _counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The index's terms in a text, ascending, and how often each is there."""
        found = [np.fromiter(map(self.term.__getitem__, _words(text.lower())), np.int64)]
        for _ in BEGINNINGS:
            found.append(self.back[found[-1]])
        at, n = np.unique(np.concatenate(found), return_counts=True)
        known = np.searchsorted(at, len(self.term))
        return at[:known], n[:known]

    def _lengthened(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights of length 1 together, and their length before."""
        weight = (1 + np.log(n)) * self.idf[at]
        length = math.sqrt(float(weight @ weight)) or 1.0
        return weight / length, length

    def _weights(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The index's terms in a text and their weights."""
        at, n = self._counts(text)
        return at, self._lengthened(at, n)[0]

    def _by_rarer(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The scores of all places by the terms that are not common, from their postings: long runs are copied, others picked."""
        score = np.empty((len(vectors), self.n_blocks * BLOCK))
        cuts = [np.searchsorted(terms, (self.n_common, self.n_long)) for terms, _ in vectors]
        most = max(int(self.having[terms[c:]].sum()) for (terms, _), (c, _) in zip(vectors, cuts, strict=True))
        all_at, all_places = np.empty(most, self.at.dtype), np.empty(most, np.int64)  # used for one text after another: fresh memory costs more than a copy
        for j, ((terms, weights), (c, r)) in enumerate(zip(vectors, cuts, strict=True)):
            picked = _ranges(self.start[terms[r:]], self.having[terms[r:]])
            n = int(self.having[terms[c:]].sum())
            at = np.concatenate([*map(self.long.__getitem__, terms[c:r].tolist()), self.at[picked]], out=all_at[:n])
            places = all_places[:n]
            places[:] = at
            n = self.runs[terms[c:] + 1] - self.runs[terms[c:]]
            runs = _ranges(self.runs[terms[c:]], n)
            weight = np.repeat(np.repeat(weights[c:], n) * self.loudness[runs], self.size[runs])
            score[j] = np.bincount(places, weight, score.shape[1])
        score[:, : len(self.length)] /= self.length
        return score.reshape(len(vectors), -1, BLOCK)

    def _search(self, blocks: np.ndarray, score: np.ndarray, common: np.ndarray) -> None:
        """Adds the common terms' part to the scores of the blocks that are marked, by query and block; a block meets all its queries in one product."""
        for b in np.flatnonzero(blocks.any(axis=0)).tolist():
            of = np.flatnonzero(blocks[:, b])
            score[of, b] += common[of] @ self.dense[b].T

    def _nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, but: int | None = None):
        """For each vector the places and cosines of its k nearest examples that share a term, in order. With but, vector j is example but + j and leaves itself out."""
        if not self.n_blocks:
            yield from ((np.empty(0, np.int64), np.empty(0)) for _ in vectors)
            return
        common, score = np.zeros((len(vectors), self.n_common)), self._by_rarer(vectors)
        for j, (terms, weights) in enumerate(vectors):
            c = np.searchsorted(terms, self.n_common)
            common[j, terms[:c]] = weights[:c]
            if but is not None:
                score[j, (but + j) // BLOCK, (but + j) % BLOCK] = -np.inf
        bound = score.max(axis=2) + common @ self.most.T
        done = np.zeros(bound.shape, bool)
        np.put_along_axis(done, np.argsort(-bound, axis=1, kind="stable")[:, : max(8, -(-4 * k // BLOCK))], True, axis=1)
        done &= bound > 0
        self._search(done, score, common)
        floor = np.full(len(vectors), -np.inf)
        for j in np.flatnonzero(done.sum(axis=1) * BLOCK > k).tolist():
            floor[j] = np.partition(score[j, done[j]], -k, axis=None)[-k]
        rest = ~done & (bound > 0) & (bound >= floor[:, None] - 1e-9)
        self._search(rest, score, common)
        done |= rest
        for j in range(len(vectors)):
            found = score[j, done[j]].ravel()
            places = (np.flatnonzero(done[j])[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            if len(found) > 4 * k:
                few = found >= np.partition(found, -k)[-k] - 1e-9
                found, places = found[few], places[few]
            best = np.lexsort((places, -np.round(found, 12)))[:k]
            best = best[found[best] > 0]
            yield places[best], found[best]

    def nearest(self, text: str, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples that share a term, in order."""
        return next(self._nearest([self._weights(text)], k))

    def _votes(self, at: np.ndarray, cosine: np.ndarray) -> list[float]:
        """The shares of label 1 among the FEW nearest and all neighbours, weighted by nearness: 20 at distance 0, almost nothing if little is shared."""
        if not len(at):
            return [self.share] * (len(FEW) + 1)
        vote = cosine / (0.05 + np.maximum(0.0, 1 - cosine))
        return [float(vote[:k] @ self.labels[at[:k]] / vote[:k].sum()) for k in (*FEW, None)]

    def _calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]], n0: int, n1: int) -> None:
        """The logistic curve from the votes to the share of label 1 among n0 + n1 rows, by Newton's steps on the examples, each without itself."""
        y = self.labels
        self.curve, self.share = None, float(y.mean()) if len(y) else self.prior
        if not 0 < self.share < 1 or not n0 or not n1:
            return
        groups = range(0, len(vectors), GROUP)
        x = np.array([self._votes(*found) for g in groups for found in self._nearest(vectors[g : g + GROUP], self.reach, g)])
        weight = np.where(y == 1, n1 / self.share, n0 / (1 - self.share)) / (n0 + n1)
        middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.hstack((np.ones((len(x), 1)), (x - middle) / spread))
        b, ridge = np.zeros(z.shape[1]), np.diag([1e-3] + [1.0] * x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            b += np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ b)
        self.curve = float(b[0] - b[1:] @ (middle / spread)), b[1:] / spread

    def scores(self, texts: list[str]):
        """For each text the score, the ids of the nearest examples and the cosine of the nearest one."""
        for g in range(0, len(texts), GROUP):
            for at, cosine in self._nearest([self._weights(t) for t in texts[g : g + GROUP]], self.reach):
                if not len(at) or self.curve is None:
                    score = self.prior
                else:
                    score = 1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve[0] + float(self.curve[1] @ self._votes(at, cosine))))))
                yield score, self.ids[at[:3]].tolist(), float(cosine[0]) if len(at) else 0.0


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", usable=lambda doc_id: fold(doc_id, 3) != 1, sample: int = SAMPLE) -> bytes | None:
    """The index of at most sample labelled rows, built in one task: all rows of label 1 up to half of them, or more if label 0 has fewer."""
    prepare(docs.sparkSession)
    n = dict(labels.filter(F.col(label).isin(0, 1) & usable(F.col("doc_id"))).groupBy(F.col(label).cast("int")).count().collect())
    n0, n1 = n.get(0, 0), n.get(1, 0)
    most_1 = min(n1, max(sample // 2, sample - n0))

    def run(batches):
        rows = [(i, t or "", y) for batch in batches for i, t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(pickle.dumps(NearestExamples(rows, (n0, n1))))])], schema=arrow_schema("index binary"))

    of = [labelled(docs, labels.filter(F.col(label) == y), label, usable, most) for y, most in ((1, most_1), (0, min(n0, sample - most_1))) if most]
    found = reduce(DataFrame.unionAll, of).repartition(1).mapInArrow(run, "index binary").collect() if of else []
    return bytes(found[0][0]) if found else None


@lru_cache(maxsize=1)
def opened(index: bytes) -> NearestExamples:
    """The index, opened once in a worker for all its tasks."""
    return pickle.loads(zstandard.decompress(index))


SCORED = "doc_id long, held_out boolean, score double, predicted int, nearest array<long>, similarity double"


def apply_index(docs: DataFrame, index: bytes | None, threshold: float = 0.7) -> DataFrame:
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = opened(sent.value) if sent.value else None
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            out = list(index.scores(texts)) if index else [(0.5, [], 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([o[0] for o in out], pa.float64()), pa.array([int(o[0] >= threshold) for o in out], pa.int32()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.float64())],
                ["doc_id", "held_out", "score", "predicted", "nearest", "similarity"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")).mapInArrow(run, SCORED)
