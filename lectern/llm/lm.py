"""Scoring texts by a trigram model in Elias-Fano tries.

The model is counted over every training document, so it grows with the corpus and never sits in one place: n-grams are
dealt into shards, whose number follows the tokens, and each shard holds a trie of its share. A trie has three levels, of words, of their successors and of these pairs'
successors. Words are an Elias-Fano sequence of hashes. A lower level keeps the successors of one context side by side; where a context's range begins and ends is
read from monotone pointers, and successors are coded relative to the range, as what they add to the last value of the range before, so that the whole level is one
monotone sequence. An n-gram is found by going down: its context's place gives the range, and the successor is sought in it. With each node go quantised codes, 16 bits on
a log scale: the smoothed probability mass of the n-gram and the back-off weight of the node as a context. Words carry exact counts too, as the base score needs them. Levels lie in
one compact unlinked file that is memory-mapped.

Smoothing is by Dirichlet priors, interpolated down to single words: P(w) = (c(w) + 1) / (N + V + 1), P(w | v) = m(v w) + b(v) P(w), P(w | u v) = m(u v w) + b(u v) P(w | v), with the
mass m(v w) = c(v w) / (c(v) + MU[0]), m(u v w) = c(u v w) / (c(u v) + MU[1]) and the back-off weights b(v) = MU[0] / (c(v) + MU[0]), b(u v) = MU[1] / (c(u v) + MU[1]);
an unknown n-gram has mass 0 and an unknown context weight 1, so every text has a finite score. The first word of a text has the context of a start token alone.

Documents are tokenised once, in blocks that are kept as a bucketed table in the checkpoint folder, so that they never travel; answers come to them. A block asks each shard for its distinct n-grams, as a small trie of hashes
with the block's training counts; the shard sums the counts, builds its trie from those above zero and answers each block, also one without training documents, in the order of its
question. A shard is worked off in parts, which bounds what a task holds. A word's n-grams are in one shard, but those of frequent words are dealt by their first two words, and
pairs of very frequent words by all three, with the pair's count told to all shards that need it. So no shard grows with a frequent word. A block and a shard exchange one row.

Words are those of common.words; an end token follows each text. Words are known by 64-bit hashes, successors by 40 bits in the second level and 32 in the third: an unseen successor is taken for a seen
one with a chance of the range's size over these powers of two. Results: a null or empty text is its end token; very long texts are read whole, a block holds one at least. A row is a document, also with a repeated id;
null ids are held out of training and count as such. Without training documents N and V are 0 and every score is 0. An empty table gives an empty table. Ties do not arise. Other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bucketed, climbed, fold, give_back, numbers, planes, prepare, steps, stored, words

#: Strength of the priors in tokens, for the second and the third level: of ten pairs within 0.001 of the best mean score of a fifth of the training documents, held back, by the others.
MU = (5000.0, 5.0)

#: Tokens in a block at most, and about in a part of a shard and in a shard.
BLOCK, PART, SHARD = 3_400_000, 1_500_000, 6_000_000

#: The names of the end and the start token; no word contains white space.
NAMES = (b" end", b" start")

#: Tasks over which shards are dealt at most.
TASKS = 20_000

PAIR_BITS, TRIPLE_BITS = 40, 32

#: A word is frequent if it is more than this part of a shard's share of the tokens; very frequent if it is more than so many of all tokens.
FREQUENT, VERY_FREQUENT = 0.25, 1e-3

#: Shards among which the triples of a pair of very frequent words are dealt at most.
SPLIT = 64


# --- Elias-Fano ---------------------------------------------------------------------------------------------------------

_POP = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: By byte and number: the place of the bit that is the number-th one.
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _i in enumerate(i for i in range(8) if _b >> i & 1):
        _SELECT[_b, _k] = _i


#: Numbers that are sought at once.
ASKED = 1 << 18


class EliasFano:
    """A monotone sequence of unsigned numbers: low bits in whole bytes, high bits in unary, found through counts for each 64-bit word."""

    def __init__(self, values: np.ndarray, universe: int):
        n = self.n = len(values)
        self.low_bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        shift = np.uint64(self.low_bits)
        high = (values >> shift).astype(np.int64)
        size = n + (int(high[-1]) if n else 0) + 2
        bits = np.zeros(-(-size // 64) * 8, np.uint8)
        at = high + np.arange(n)
        np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        self.bits = bits
        ones = _POP[bits].reshape(-1, 8).sum(axis=1, dtype=np.int64)
        self.zeros = np.concatenate(([0], np.cumsum(64 - ones)))  # before each word
        self.ones = np.concatenate(([0], np.cumsum(ones)))
        low = values & ((np.uint64(1) << shift) - np.uint64(1))
        raw = low.astype("<u8").view(np.uint8).reshape(n, 8)
        self.low_bytes = -(-self.low_bits // 8)
        self.low = raw[:, : self.low_bytes].copy()

    def parts(self) -> list[str]:
        return ["bits", "zeros", "ones", "low"]

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), 8), np.uint8)
        out[:, : self.low_bytes] = self.low[at]
        return out.view("<u8").reshape(-1)

    def _select(self, k: np.ndarray, before_word: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(before_word, k, "right") - 1
        rest = (k - before_word[word]).astype(np.uint8)
        of = self.bits.reshape(-1, 8)[word]
        if flip:
            of = ~of
        before = np.cumsum(_POP[of], axis=1, dtype=np.uint8)
        byte = (before <= rest[:, None]).sum(axis=1, dtype=np.int64)
        flat = np.arange(0, 8 * len(word), 8) + byte
        rest -= np.where(byte > 0, before.reshape(-1)[flat - (byte > 0)], 0).astype(np.uint8)
        return word * 64 + byte * 8 + _SELECT[of.reshape(-1)[flat], rest]

    def select_zero(self, k: np.ndarray) -> np.ndarray:
        """Places of the k-th zeros, from 0."""
        return self._select(k, self.zeros, True)

    def access(self, k: np.ndarray) -> np.ndarray:
        """The numbers at places k."""
        if len(k) > ASKED:
            return np.concatenate([self.access(k[i : i + ASKED]) for i in range(0, len(k), ASKED)])
        high = (self._select(k, self.ones, False) - k).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._low(k)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Places of the numbers x, -1 for those that are absent: successor search within the numbers of equal high bits."""
        if len(x) > ASKED:
            return np.concatenate([self.find(x[k : k + ASKED]) for k in range(0, len(x), ASKED)])
        found = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return found
        shift = np.uint64(self.low_bits)
        high = (x >> shift).astype(np.int64)
        ok = np.flatnonzero(high < int(self.zeros[-1]))
        low = (x & ((np.uint64(1) << shift) - np.uint64(1)))[ok]
        high = high[ok]
        first = self.select_zero(np.maximum(high - 1, 0)) + 1 - high  # numbers with these high bits lie between two zeros
        first[high == 0] = 0
        last = self.select_zero(high) - high
        while True:
            m = first < last
            ok, low, first, last = ok[m], low[m], first[m], last[m]
            if not len(ok):
                return found
            middle = (first + last) >> 1
            value = self._low(middle)
            same, go = value == low, value < low
            found[ok[same]] = middle[same]
            last = np.where(go, last, middle)
            first = np.where(go, middle + 1, np.where(same, last, first))


# --- codes --------------------------------------------------------------------------------------------------------------

#: Code 0 stands for what is absent; the others for powers of ten from 10 ** -LOWEST to 1, in equal steps of the exponent.
LOWEST = 14.0
STEP = LOWEST / 65534
VALUES = np.concatenate(([0.0], 10.0 ** (-STEP * np.arange(65535))))


def quantise(shares: np.ndarray) -> np.ndarray:
    """The nearest codes of shares above 0 on the log scale."""
    return (1 + np.clip(np.round(-np.log10(shares) / STEP), 0, 65534)).astype(np.uint16)


# --- the trie -----------------------------------------------------------------------------------------------------------


class Level:
    """Successors by context: context k has those from pointer k to pointer k + 1, ascending, relative to the last value before."""

    def __init__(self, context: np.ndarray, successors: np.ndarray, contexts: int):
        """context and successors are sorted together; contexts is the number of contexts, some without successors."""
        starts = np.concatenate(([0], np.cumsum(np.bincount(context, minlength=contexts)[:contexts])))
        self.pointers = EliasFano(starts.astype(np.uint64), max(1, len(context)) + 1)
        last = np.flatnonzero(np.append(context[1:] != context[:-1], True)) if len(context) else np.empty(0, np.int64)
        ends = np.cumsum(successors[last] + np.uint64(1), dtype=np.uint64)  # one more than the last value of each range
        added = np.repeat(np.concatenate((np.zeros(1, np.uint64), ends[:-1])), np.diff(np.concatenate(([-1], last)))) if len(last) else np.empty(0, np.uint64)
        values = successors + added
        self.values = EliasFano(values, int(values[-1]) + 1 if len(values) else 1)

    def find(self, context: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Places of successors in the ranges of their contexts, -1 for the absent; context is ascending, and -1 where it is absent itself."""
        found = np.full(len(context), -1, np.int64)
        known = np.flatnonzero(context >= 0)
        if not len(known) or not self.values.n:
            return found
        of = context[known]
        first = np.append(True, of[1:] != of[:-1])
        distinct = of[first]
        start, end = (self.pointers.access(x).astype(np.int64) for x in (distinct, distinct + 1))
        base = np.where(start > 0, self.values.access(np.maximum(start - 1, 0)) + np.uint64(1), np.uint64(0))
        nth = np.cumsum(first) - 1
        at = self.values.find(base[nth] + successors[known])
        inside = (at >= start[nth]) & (at < end[nth])
        found[known[inside]] = at[inside]
        return found


class Trie:
    """One part's n-grams in memory-mapped levels."""

    def __init__(self, word_keys, word_counts, pair_word, pair_keys, pair_counts, triple_pair, triple_keys, triple_counts, mu=MU):
        """Levels sorted by context and key, all counts above 0; contexts are places in the level above."""
        self.words = EliasFano(word_keys >> np.uint64(1), 1 << 63)
        self.pairs = Level(pair_word, pair_keys, len(word_keys))
        self.triples = Level(triple_pair, triple_keys, len(pair_keys))
        self.counts = word_counts.astype(np.int64)
        self.word_back = quantise(mu[0] / (word_counts + mu[0]))
        self.pair_mass = quantise(pair_counts / (word_counts[pair_word] + mu[0]))
        self.pair_back = quantise(mu[1] / (pair_counts + mu[1]))
        self.triple_mass = quantise(triple_counts / (pair_counts[triple_pair] + mu[1]))
        self._map()

    def _map(self) -> None:
        """Moves the levels into one file without a name, and maps it."""
        levels = [(level, name) for level in (self.words, self.pairs.pointers, self.pairs.values, self.triples.pointers, self.triples.values) for name in level.parts()]
        levels += [(self, name) for name in ("counts", "word_back", "pair_mass", "pair_back", "triple_mass")]
        with tempfile.TemporaryFile() as f:
            spots = []
            for level, name in levels:
                data = np.ascontiguousarray(getattr(level, name))
                f.write(b"\0" * (-f.tell() % 8))
                spots.append((level, name, f.tell(), data.dtype, data.shape))
                f.write(data.tobytes())
            f.flush()
            for level, name, at, dtype, shape in spots:
                if math.prod(shape):
                    setattr(level, name, np.asarray(np.memmap(f, dtype, "r", at, shape)))

    @staticmethod
    def _of(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, values[np.maximum(at, 0)], 0).astype(values.dtype) if len(values) else np.zeros(len(at), values.dtype)

    def ask(self, word_keys, pair_word, pair_keys, triple_pair, triple_keys):
        """Counts and back-off codes of words, mass and back-off codes of pairs, mass codes of triples. Contexts are places among the asked words and pairs."""
        w = self.words.find(word_keys >> np.uint64(1))
        p = self.pairs.find(w[pair_word], pair_keys)
        t = self.triples.find(p[triple_pair], triple_keys)
        of = self._of
        return of(self.counts, w), of(self.word_back, w), of(self.pair_mass, p), of(self.pair_back, p), of(self.triple_mass, t)


# --- blocks -------------------------------------------------------------------------------------------------------------


class Numbers(dict):
    """Local numbers of words in order of appearance."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _join(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts)) + b"".join(parts)


def _split(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<q", data)
    out, at = [], 8 * n + 8
    for size in struct.unpack_from(f"<{n}q", data, 8):
        out.append(data[at : at + size])
        at += size
    return out


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _scaled(h: np.ndarray, shards: int) -> np.ndarray:
    """Numbers of shards, ascending with h."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and for each key its place among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.append(True, ordered[1:] != ordered[:-1]) if len(keys) else np.empty(0, bool)
    place = np.empty(len(keys), np.int32 if len(keys) < 1 << 31 else np.int64)
    place[order] = np.cumsum(new, dtype=place.dtype) - 1
    return ordered[new], place


END_HASH, START_HASH = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in NAMES)


class Block:
    """Some documents: tokens as places among the sorted hashes of the block's words (documents end with the end token), their documents' lengths, ids and folds."""

    def __init__(self, tokens, lengths, ids, id_known, held, hashes):
        self.tokens, self.lengths, self.ids, self.id_known, self.held, self.hashes = tokens, lengths, ids, id_known, held, hashes

    def dump(self) -> bytes:
        """The block in bytes; tokens as ranks by frequency, which take less room. The ranks follow from the counts."""
        counts = np.bincount(self.tokens, minlength=len(self.hashes)).astype(np.uint32)
        by_rank = np.argsort(-counts.astype(np.int64), kind="stable")
        rank = np.empty(len(by_rank), np.uint32)
        rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
        return _join(planes(rank[self.tokens]), planes(counts), planes(self.lengths), planes(self.ids), planes(self.id_known), planes(self.held), steps(self.hashes))

    @classmethod
    def load(cls, data: bytes) -> Block:
        t, c, n, i, k, h, x = _split(data)
        by_rank = np.argsort(-numbers(c, np.uint32).astype(np.int64), kind="stable").astype(np.uint32)
        return cls(by_rank[numbers(t, np.uint32)], numbers(n, np.int64), numbers(i, np.int64), numbers(k, np.uint8), numbers(h, np.uint8), climbed(x))

    def trained(self) -> np.ndarray:
        """Whether each token is one of a training document."""
        return np.repeat(self.held == 0, self.lengths)

    def grams(self):
        """The distinct pairs (word, word) and triples (pair, word), sorted, and for each token the places of its own; triples are those of tokens that are not first."""
        self.starts = np.append(0, np.cumsum(self.lengths)[:-1])
        size = np.uint64(len(self.hashes))
        keys = np.empty(len(self.tokens), np.uint64)
        keys[1:] = self.tokens[:-1]
        keys[self.starts] = np.searchsorted(self.hashes, START_HASH)
        keys *= size
        keys += self.tokens
        keys, self.pair_at = _distinct(keys)
        self.pair_a, self.pair_b = (keys // size).astype(np.int32), (keys % size).astype(np.int32)
        later = np.ones(len(self.tokens), bool)
        later[self.starts] = False
        self.later = np.flatnonzero(later).astype(np.int32)
        keys = self.pair_at[self.later - 1].astype(np.uint64)
        keys *= size
        keys += self.tokens[self.later]
        keys, self.triple_at = _distinct(keys)
        self.triple_p, self.triple_c = (keys // size).astype(np.int32), (keys % size).astype(np.int32)

    def deal(self, shards: int, frequent: np.ndarray, very: np.ndarray):
        """Deals words, pairs and triples to shards; frequent and very are sorted hashes of words.

        Sets arrays in the order of shards: entries of words (a word may also stand where only its pairs are), of pairs (a pair may also stand where only its triples are) and of
        triples, and where each shard's begin.
        """
        self.grams()
        h, words_, pairs_ = self.hashes, len(self.hashes), len(self.pair_a)
        among = lambda of: np.isin(h, of, assume_unique=True)
        hot, very_hot = among(frequent), among(very)
        home = _scaled(h, shards)
        a, b = self.pair_a, self.pair_b
        shard = home[a]
        apart = np.flatnonzero(hot[a])
        shard[apart] = _scaled(_mixed(h[a[apart]], h[b[apart]]), shards)
        split = min(SPLIT, shards)
        stride = shards // split
        wide = very_hot[a] & very_hot[b] & (split > 1)
        copies = np.flatnonzero(wide)
        every = (shard[copies][:, None] + np.arange(split) * stride) % shards
        # pairs: those at their own shard come first among the copies
        pair_key = np.concatenate((shard * pairs_ + np.arange(pairs_), (every[:, 1:] * pairs_ + copies[:, None]).ravel()))
        order = np.argsort(pair_key, kind="stable")
        pair_key = pair_key[order]
        self.pair_of = (pair_key % max(1, pairs_)).astype(np.int32)
        self.pair_slot = np.empty(pairs_, np.int64)  # where each pair's own entry is
        own = order < pairs_
        self.pair_slot[self.pair_of[own]] = np.flatnonzero(own)
        pair_shard = pair_key // max(1, pairs_)
        del order, own, every
        # triples
        triple_shard = shard.astype(np.uint16 if shards <= 1 << 16 else np.int64)[self.triple_p]
        spread = np.flatnonzero(wide[self.triple_p])
        triple_shard[spread] = (triple_shard[spread] + (_mixed(h[self.triple_c[spread]], h[a[self.triple_p[spread]]]) % np.uint64(split)).astype(np.int64) * stride) % shards
        self.triple_of = np.argsort(triple_shard, kind="stable").astype(np.int32)
        triple_shard = triple_shard[self.triple_of]
        entry = triple_shard.astype(np.int64) * pairs_
        entry += self.triple_p[self.triple_of]
        entry = np.searchsorted(pair_key, entry)
        self.triples_of_pair = np.bincount(entry, minlength=len(pair_key))
        del entry, pair_key
        # words
        needed = pair_shard * words_ + a[self.pair_of]
        needed = needed[np.append(True, needed[1:] != needed[:-1])] if len(needed) else needed
        word_key = np.unique(np.concatenate((home * words_ + np.arange(words_), needed)))
        self.word_of = word_key % words_
        word_shard = word_key // words_
        self.word_home = word_shard == home[self.word_of]
        self.pairs_of_word = np.bincount(np.searchsorted(word_key, pair_shard * words_ + a[self.pair_of]), minlength=len(word_key))
        self.bounds = [np.concatenate(([0], np.cumsum(np.bincount(x, minlength=shards)))) for x in (word_shard, pair_shard, triple_shard)]

    def counts(self):
        """The training counts of the entries; a word counts at its home alone, the start token once a document."""
        train = self.trained()
        word = np.bincount(self.tokens[train], minlength=len(self.hashes))
        word[np.searchsorted(self.hashes, START_HASH)] = int((self.held == 0).sum())
        pair = np.bincount(self.pair_at[train], minlength=len(self.pair_a))
        triple = np.bincount(self.triple_at[train[self.later]], minlength=len(self.triple_p))
        return tuple(x.astype(np.uint32) for x in (np.where(self.word_home, word[self.word_of], 0), pair[self.pair_of], triple[self.triple_of]))


def question(block: Block, counts, shard: int) -> bytes:
    """What a block asks one part: its words, pairs by word and triples by pair, with counts; empty if it asks nothing."""
    (a, b), (c, d), (e, f) = ((x[shard], x[shard + 1]) for x in block.bounds)
    if a == b:
        return b""
    small = lambda x: planes(x.astype(np.uint32))
    successor = lambda of, bits: block.hashes[of] >> np.uint64(64 - bits)
    return _join(
        steps(block.hashes[block.word_of[a:b]]), small(counts[0][a:b]), small(block.pairs_of_word[a:b]),
        planes(successor(block.pair_b[block.pair_of[c:d]], PAIR_BITS)), small(counts[1][c:d]), small(block.triples_of_pair[c:d]),
        planes(successor(block.triple_c[block.triple_of[e:f]], TRIPLE_BITS).astype(np.uint32)), small(counts[2][e:f]),
    )


def part_answers(questions: list[bytes], frequent: np.ndarray, frequent_counts: np.ndarray, mu=MU) -> list[bytes]:
    """Builds the trie of one part from the counts in all its questions, and answers each of them in its own order."""
    asked = [_split(q) for q in questions]
    u32 = lambda k: [numbers(x[k], np.uint32) for x in asked]
    joined = lambda parts, dtype: np.concatenate([np.empty(0, dtype), *parts])
    word_parts, pair_parts, triple_parts = [climbed(x[0]) for x in asked], [numbers(x[3], np.uint64) for x in asked], u32(6)
    sizes = [np.array([len(x) for x in parts], np.int64) for parts in (word_parts, pair_parts, triple_parts)]
    words_, word_at = _distinct(joined(word_parts, np.uint64))
    word_count = np.bincount(word_at, joined(u32(1), np.uint32), len(words_)).astype(np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, words_), len(frequent) - 1)
        word_count = np.where(frequent[at] == words_, frequent_counts[at], word_count)
    pair_keys, pair_at = _distinct((np.repeat(word_at, joined(u32(2), np.uint32)).astype(np.uint64) << np.uint64(PAIR_BITS)) | joined(pair_parts, np.uint64))
    pair_count = np.bincount(pair_at, joined(u32(4), np.uint32), len(pair_keys)).astype(np.int64)
    triple_keys, triple_at = _distinct((np.repeat(pair_at, joined(u32(5), np.uint32)).astype(np.uint64) << np.uint64(TRIPLE_BITS)) | joined(triple_parts, np.uint32).astype(np.uint64))
    triple_count = np.bincount(triple_at, joined(u32(7), np.uint32), len(triple_keys)).astype(np.int64)
    pair_word, pair_keys = (pair_keys >> np.uint64(PAIR_BITS)).astype(np.int64), pair_keys & np.uint64((1 << PAIR_BITS) - 1)
    triple_pair, triple_keys = (triple_keys >> np.uint64(TRIPLE_BITS)).astype(np.int64), triple_keys & np.uint64((1 << TRIPLE_BITS) - 1)
    w, p, t = word_count > 0, pair_count > 0, triple_count > 0
    place = lambda kept: np.cumsum(kept) - 1
    trie = Trie(words_[w], word_count[w], place(w)[pair_word[p]], pair_keys[p], pair_count[p], place(p)[triple_pair[t]], triple_keys[t], triple_count[t], mu)
    counts, word_back, pair_mass, pair_back, triple_mass = trie.ask(words_, pair_word, pair_keys, triple_pair, triple_keys)
    ends = [np.concatenate(([0], np.cumsum(x))) for x in sizes]
    out = []
    for k in range(len(asked)):
        wi, pi, ti = (at[e[k] : e[k + 1]] for at, e in zip((word_at, pair_at, triple_at), ends, strict=True))
        out.append(_join(planes(counts[wi]), planes(word_back[wi]), planes(pair_mass[pi]), planes(pair_back[pi]), planes(triple_mass[ti])))
    return out


def blocks(batches, most: int = BLOCK) -> Iterator[Block]:
    """Tokenises (doc_id, text, held_out) batches."""
    of, ids, known, held, n = [], [], [], [], 0

    def fresh_numbers():
        out = Numbers()
        for name in NAMES:
            out[name] = len(out)
        return out

    number = fresh_numbers()

    def done():
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
        sorted_hashes, rank = _distinct(hashes)
        return Block(rank.astype(np.uint32)[np.concatenate(of)], np.array([len(x) for x in of], np.int64), np.array(ids, np.int64), np.array(known, np.uint8), np.array(held, np.uint8), sorted_hashes)

    for batch in batches:
        for doc_id, text, out in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = words(text)
            tokens = np.empty(len(found) + 1, np.uint32)
            tokens[:-1] = np.fromiter(map(number.__getitem__, found), np.uint32, len(found))
            tokens[-1] = 0
            of.append(tokens)
            ids.append(doc_id or 0)
            known.append(doc_id is not None)
            held.append(bool(out))
            n += len(tokens)
            if n >= most:
                yield done()
                of, ids, known, held, n, number = [], [], [], [], 0, fresh_numbers()
                give_back()
    if of:
        yield done()


# --- tables -------------------------------------------------------------------------------------------------------------

#: Candidates for frequent words that one task of the vocabulary names at most; a frequent word beyond them is dealt like others.
NAMED = 64


def vocabulary(table: DataFrame, parts: int) -> DataFrame:
    """(n, every, v, words, counts) by part of the hashes: training tokens, all tokens, distinct training tokens, and the most frequent of them with their counts."""

    def run(batches):
        schema = arrow_schema("part int, n long, every long, keys binary, counts binary")
        for batch in batches:
            for data in batch.column(0):
                block = Block.load(data.as_py())
                counts = np.bincount(block.tokens[block.trained()], minlength=len(block.hashes))
                seen = np.flatnonzero(counts)
                ends = np.searchsorted(_scaled(block.hashes[seen], parts), np.arange(parts + 1))
                n = np.diff(np.concatenate(([0], np.cumsum(counts[seen])))[ends])
                some = sorted({0, *np.flatnonzero(np.diff(ends)).tolist()})
                each = [seen[ends[s] : ends[s + 1]] for s in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip((some, n[some], [len(block.tokens) if s == 0 else 0 for s in some], [steps(block.hashes[k]) for k in each], [planes(counts[k].astype(np.uint32)) for k in each]), schema.types, strict=True)],
                    schema=schema,
                )

    def merged(key: tuple[pa.Scalar, ...], given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = every = 0
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in given:
            n, every = n + sum(batch.column("n").to_pylist()), every + sum(batch.column("every").to_pylist())
            more = [climbed(k) for k in batch.column("keys").to_pylist()]
            weights = np.concatenate([counts, *(numbers(c, np.uint32) for c in batch.column("counts").to_pylist())])
            keys, at = _distinct(np.concatenate([keys, *more]))
            counts = np.bincount(at, weights, len(keys)).astype(np.int64)
        top = np.argsort(-counts, kind="stable")[:NAMED]
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([every]), pa.array([len(keys)]), pa.array([keys[top].view(np.int64).tolist()], pa.list_(pa.int64())), pa.array([counts[top].tolist()], pa.list_(pa.int64()))], ["n", "every", "v", "words", "counts"])

    return table.select("payload").mapInArrow(run, "part int, n long, every long, keys binary, counts binary").groupBy("part").applyInArrow(merged, "n long, every long, v long, words array<long>, counts array<long>")


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2, mu=MU, block_tokens: int = BLOCK, part_tokens: int = PART, shard_tokens: int = SHARD) -> DataFrame:
    """Scores all documents by a model of those whose fold is not held."""
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(True)).alias("held_out"))

    def tokenise(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 20
        for serial, block in enumerate(blocks(batches, block_tokens)):
            yield pa.RecordBatch.from_arrays([pa.array([base + serial]), pa.array([block.dump()], pa.binary())], schema=arrow_schema("block long, payload binary"))
        give_back()

    cores = spark.sparkContext.defaultParallelism
    table = bucketed(source.mapInArrow(tokenise, "block long, payload binary"), "blocks", "block", min(50_000, max(2 * cores, source.rdd.getNumPartitions())))
    seen, drop_seen = stored(vocabulary(table, max(cores, table.count())), "vocabulary")
    n_train, every, n_distinct = (x or 0 for x in seen.agg(F.sum("n"), F.sum("every"), F.sum("v")).first())
    denominator = n_train + n_distinct + 1
    shards = max(2 * cores, -(-every // shard_tokens))
    parts = max(1, -(-every // (shards * part_tokens)))  # of a shard
    # frequent words: fewer than shards * parts / FREQUENT, whatever the text
    least = FREQUENT * n_train / (shards * parts)
    named = seen.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select("x.words", "x.counts").filter(F.col("counts") > least).collect()
    drop_seen()
    often = {np.uint64(r.words & (1 << 64) - 1): r.counts for r in named}
    if END_HASH in often:
        often[START_HASH] = often[END_HASH]  # each training document starts once
    frequent = np.sort(np.array(list(often), np.uint64))
    frequent_counts = np.array([often[x] for x in frequent], np.int64)
    very = frequent[frequent_counts > VERY_FREQUENT * n_train]
    sent = spark.sparkContext.broadcast((frequent, frequent_counts, very))

    def ask(batches):
        schema = arrow_schema("block long, shard int, payload binary")
        for batch in batches:
            for name, data in zip(*batch.columns, strict=True):
                block = Block.load(data.as_py())
                block.deal(shards * parts, sent.value[0], sent.value[2])
                counts = block.counts()
                give_back()
                for s in range(shards):
                    asked = [question(block, counts, s * parts + k) for k in range(parts)]
                    if any(asked):
                        yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([s], pa.int32()), pa.array([_join(*asked)], pa.binary())], schema=schema)

    def by_shard(given: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[list[bytes]]]]:
        """A task's shards one after the other, with the names of the blocks that ask and their questions."""
        shard, names, asked = None, [], []
        for batch in given:
            for name, s, x in zip(*(batch.column(c) for c in ("block", "shard", "payload")), strict=True):
                if names and s.as_py() != shard:
                    yield shard, names, asked
                    names, asked = [], []
                shard = s.as_py()
                names.append(name.as_py())
                asked.append(_split(x.as_py()))
        if names:
            yield shard, names, asked

    def answer(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, names, asked in by_shard(given):
            found: list[list[bytes]] = [[b""] * parts for _ in names]
            for k in range(parts):
                some = [i for i, x in enumerate(asked) if x[k]]
                if some:
                    for i, x in zip(some, part_answers([asked[i][k] for i in some], *sent.value[:2], mu), strict=True):
                        found[i][k] = x
                        asked[i][k] = b""
                    give_back()
            for name, x in zip(names, found, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([shard], pa.int32()), pa.array([_join(*x)], pa.binary())], ["block", "shard", "payload"])

    def score(key: tuple[pa.Scalar, ...], given: pa.Table, found: pa.Table) -> pa.Table:
        block = Block.load(given.column("payload")[0].as_py())
        found = dict(zip(found.column("shard").to_pylist(), found.column("payload").to_pylist(), strict=True))
        block.deal(shards * parts, sent.value[0], sent.value[2])
        each = [_split(x) for s in sorted(found) for x in _split(found[s]) if x]
        counts, word_back, pair_mass, pair_back, triple_mass = (np.concatenate([numbers(x[k], t) for x in each]) for k, t in enumerate((np.int64, np.uint16, np.uint16, np.uint16, np.uint16)))
        home = np.flatnonzero(block.word_home)
        home = home[np.argsort(block.word_of[home])]  # by word
        count, back_1 = counts[home].astype(float), np.where(word_back[home] > 0, VALUES[word_back[home]], 1.0)
        mass_2, back_2 = VALUES[pair_mass[block.pair_slot]], np.where(pair_back[block.pair_slot] > 0, VALUES[pair_back[block.pair_slot]], 1.0)
        mass_3 = np.empty(len(block.triple_of))
        mass_3[block.triple_of] = VALUES[triple_mass]
        known = count[block.tokens]
        plain = (known + 1) / denominator
        smoothed = mass_2[block.pair_at] + back_1[block.pair_a[block.pair_at]] * plain
        smoothed[block.later] = mass_3[block.triple_at] + back_2[block.pair_at[block.later - 1]] * smoothed[block.later]
        cols = {
            "doc_id": pa.array(block.ids, pa.int64(), mask=block.id_known == 0),
            "held_out": pa.array(block.held > 0),
            "n_tokens": pa.array(block.lengths),
            "n_known": pa.array(np.add.reduceat((known > 0).astype(np.int64), block.starts)),
            "train_tokens": pa.array(np.full(len(block.lengths), n_train, np.int64)),
            "base_score": pa.array(np.add.reduceat(np.log10(plain), block.starts)),
            "score": pa.array(np.add.reduceat(np.log10(smoothed), block.starts)),
        }
        out = pa.Table.from_pydict(cols, schema=arrow_schema(SCORED))
        del cols, known, plain, smoothed, mass_2, back_2, mass_3, block, each
        give_back()
        return out

    # dealt by number, so that no task gets two shards while another has none
    tasks = min(TASKS, shards)
    asked = table.mapInArrow(ask, "block long, shard int, payload binary").repartitionById(tasks, F.expr(f"shard % {tasks}"))
    answers = (asked if tasks == shards else asked.sortWithinPartitions("shard")).mapInArrow(answer, "block long, shard int, payload binary")
    return table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORED)
