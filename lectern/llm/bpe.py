"""Byte-pair encoding and decoding by dynamic programming over prefixes.

A text is cut into pre-tokens; each distinct pre-token is encoded once and remembered. For every prefix of a
pre-token exactly one token can end its encoding, so one array of last tokens describes the encodings of all
prefixes. A suffix-link automaton of the vocabulary reports every token that is a suffix of the prefix; a token is
the prefix's last one if the rest of the prefix is empty or the rest's own last token is compatible with it: merges
would leave the two side by side. Back-pointers from the end then give the ids. The time is linear in the text, also
for one very long pre-token.

Results: a null text counts as empty (no tokens, hashes of the empty string). Rows with equal ids or texts are
encoded independently, one result row for each input row; very long texts and pre-tokens are encoded whole; other columns are ignored. No ties
arise, as a prefix has one encoding; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_schema, prepare

#: Characters outside these blocks may be classed differently by different Unicode versions of regular-expression
#: engines; texts that hold one are cut by the tokenizer library's own pre-tokenizer.
UNSETTLED = re.compile("[^\x00-԰ -⁰₠-₿℀-⯿　-龥가-힣＀-￯]")

#: Pre-tokens that one worker remembers before it forgets the older half; longer ones than LONG characters are not remembered, so a memo is bounded in bytes too.
REMEMBERED, LONG = 800_000, 64

#: Characters on which Python's own regular expressions class differently from the tokenizer's: information separators, numbers
#: that are no digits, and all beyond the extended Latin letters. Texts without them are cut by the faster engine.
BEYOND_PLAIN = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")

NO_RANK = 1 << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 for itself, the others from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Remembered(dict):
    """A memo of two generations: bounded memory, and what is used often stays."""

    def __init__(self, make, most: int = REMEMBERED, long: int | None = None):
        """long: the length beyond which a key is not remembered; None if all keys are short."""
        super().__init__()
        self.make, self.most, self.old, self.long = make, most // 2, {}, long

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if self.long is not None and len(key) > self.long:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PrefixBPE:
    """The byte-level BPE of a vocabulary file, by the method in this module's docstring."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        spelled = {token: bytes(map(to_byte.__getitem__, token)) for token in model["vocab"]}
        self.bytes_of: dict[int, bytes] = {i: spelled[token] for token, i in model["vocab"].items()}
        #: By a token's id: the rank of the merge that makes it (-1 for a single byte) and its two parts.
        self.rank = dict.fromkeys(self.bytes_of, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        #: By a pair of ids: the rank of its merge.
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.merge[left, right] = rank
            if whole not in self.parts:
                self.rank[whole], self.parts[whole] = rank, (left, right)
        self.suffixes = ahocorasick.Automaton()
        for i, token in self.bytes_of.items():
            self.suffixes.add_word(token.decode("latin-1"), (len(token), i))
        self.suffixes.make_automaton()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.plain_pieces = re.compile(public_tokenizers.PATTERN.replace(r"\p{L}+", r"[^\W\d_]+").replace(r"\p{N}+", r"\d+").replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+")).findall
        self.path = path
        self.fits = Remembered(self._fits, 1_000_000)
        self.ids_of = Remembered(lambda piece: self.encode_bytes(piece.encode()), long=LONG)

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether merges leave the two tokens side by side.

        Looks back in time from the finished tokens along the left one's right edge and the right one's left edge: while
        two edge parts stand side by side, a merge of the two that comes before the next merge of either would join them.
        """
        a, b = pair
        a_until = b_until = NO_RANK
        while True:
            rank = self.merge.get((a, b))
            if rank is not None and rank < a_until and rank <= b_until:
                return False
            if self.rank[a] < 0 and self.rank[b] < 0:
                return True
            if self.rank[a] > self.rank[b]:  # of two equal merges the left one comes first, so the right one goes first here
                a_until, a = self.rank[a], self.parts[a][1]
            else:
                b_until, b = self.rank[b], self.parts[b][0]

    def encode_bytes(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        last = [-1] * (len(piece) + 1)
        fits = self.fits
        for end, (length, token) in self.suffixes.iter(piece.decode("latin-1")):
            if last[end + 1] < 0:
                start = end + 1 - length
                if not start or fits[last[start], token]:
                    last[end + 1] = token
        ids, end = [], len(piece)
        while end:
            ids.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return tuple(reversed(ids))

    def cut(self, text: str) -> list[str] | list[bytes]:
        """The pre-tokens of a text without special tokens."""
        if not BEYOND_PLAIN.search(text):
            return self.plain_pieces(text)
        if UNSETTLED.search(text):
            return [text[a:b] for _, (a, b) in _library(self.path).pre_tokenizer.pre_tokenize_str(text)]
        return self.pieces(text)

    def encode(self, text: str) -> list[int]:
        ids_of = self.ids_of
        if self.specials is None or "<|" not in text:
            return list(chain.from_iterable(map(ids_of.__getitem__, self.cut(text))))
        out: list[int] = []
        for k, part in enumerate(self.specials.split(text)):
            out.extend([self.special[part]] if k % 2 else chain.from_iterable(map(ids_of.__getitem__, self.cut(part))))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def codec(path: str) -> PrefixBPE:
    return PrefixBPE(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the whole texts' ids, in one pass without a shuffle."""
    prepare(docs.sparkSession)

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            ids = [bpe.encode(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the texts that arrays of ids stand for."""
    prepare(encoded.sparkSession)

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """For each document the number of its ids, a hash of them and a hash of what they decode to."""
    prepare(docs.sparkSession)

    def run(batches):
        bpe, schema = codec(path), arrow_schema(DIGEST)
        digits = {i: str(i) for i in bpe.bytes_of}
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text or "")
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}, schema=schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, DIGEST)
