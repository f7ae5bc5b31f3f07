"""Vector best-fit packing of tokenised documents into training sequences.

A sequence (bin) has three capacities: tokens, documents and attention cost (the sum of squared piece lengths, what
block-diagonal attention pays). Pieces are placed longest first; among the open bins in which every residual
capacity suffices, the one is taken with the least weighted norm of what would remain (rule "norm") or the greatest
weighted dot product of demand and residual (rule "dot"); if there is none, a bin opens. Capacities that other
capacities imply (as many documents as tokens, the squared token capacity as cost) never bind. Documents are cut into pieces that an empty bin can hold; a piece that none can hold
is an error.

Pieces are dealt in turn into groups of about GROUP, so equal rows spread like others, packed one group at a time, so that no task holds more than one
group's bins; then the bins of all groups that are least full are emptied and packed once more, together. Tokens
never travel: a piece is its document, place, length and checksum.

Results: a null text counts as empty and yields one piece, the end token. Documents with equal ids or equal texts
are packed each for itself; very long texts are cut, never shortened; ties go to the bin that opened first. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LONG, UNSETTLED, Remembered, byte_letters
from .common import arrow_schema, checkpointed, prepare

MAX_TOKENS = 2048

#: Pieces that are packed together: enough for waste to vanish, few enough for a task.
GROUP = 8192

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


class WordIds:
    """Ids of whole texts as packed little-endian 32-bit integers, by a vocabulary file with word ends.

    Words repeat, so each distinct word is encoded once by the library's model and remembered. Texts with characters that
    Unicode versions class differently go through the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = {content: int(i).to_bytes(4, "little") for content, i in added.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.letters = byte_letters()
        self.of = Remembered(self.word, long=LONG)

    def word(self, word: str) -> bytes:
        return np.array([t.id for t in self.library.model.tokenize("".join(map(self.letters.__getitem__, word.encode())))], "<u4").tobytes()

    def plain(self, text: str) -> bytes:
        """The ids of a text without special tokens; lower case goes letter by letter, so a final sigma is not special."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return b"".join(map(self.of.__getitem__, self.words(text.lower())))

    def __call__(self, text: str) -> bytes:
        if not text.isascii() and UNSETTLED.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.specials is None or "<|" not in text:
            return self.plain(text)
        return b"".join(self.special[part] if k % 2 else self.plain(part) for k, part in enumerate(self.specials.split(text)))


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cut_documents(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, end_id: int = 0) -> DataFrame:
    """The pieces of every document: its ids and the end token, cut only where a document is longer than a sequence."""
    prepare(docs.sparkSession)

    def run(batches):
        encode, schema, end = word_ids(path), arrow_schema(PIECES), end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[at : at + 4 * max_tokens]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, max_tokens: int, max_docs: int, max_cost: int, weights=(1.0, 0.05, 0.05), rule: str = "norm") -> tuple[np.ndarray, np.ndarray, int]:
    """For each piece its bin and offset, and the number of bins. Ties go to the bin that opened first."""
    n = len(lengths)
    if n and (int(lengths.max()) > max_tokens or int(lengths.max()) ** 2 > max_cost or max_docs < 1):
        raise ValueError(f"no sequence of {max_tokens} tokens, {max_docs} documents and cost {max_cost} can hold a piece of {int(lengths.max())} tokens")
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    w = np.array(weights) ** 0.5
    left = np.zeros((3, n + 1))  # residual share of tokens, documents and cost of the open bins
    name = np.zeros(n + 1, np.int64)
    used = np.zeros(n + 1, np.int64)
    opened = alive = 0
    least = int(lengths.min()) if n else 0
    eps = 1e-12
    for i in order:
        length = int(lengths[i])
        need = np.array([length / max_tokens, 1 / max_docs, length * length / max_cost])
        rest = left[:, :alive] - need[:, None]
        fits = (rest > -eps).all(axis=0)
        if fits.any():
            if rule == "norm":
                score = np.einsum("ij,i->j", rest * rest, w * w)
            else:
                score = -np.einsum("ij,i->j", left[:, :alive], need * w * w)
            score[~fits] = np.inf
            k = int(score.argmin())
        else:
            k, alive = alive, alive + 1
            left[:, k], name[k], used[k] = 1.0, opened, 0
            opened += 1
        left[:, k] -= need
        bins[i], offsets[i] = name[k], used[k]
        used[k] += length
        if max_tokens - used[k] < least or left[1, k] < 1 / max_docs - eps or left[2, k] < least * least / max_cost - eps:  # nothing fits any more
            alive -= 1
            left[:, k], name[k], used[k] = left[:, alive], name[alive], used[alive]
    return bins, offsets, opened


def pack_pieces(pieces: DataFrame, max_tokens: int = MAX_TOKENS, max_docs: int | None = None, max_cost: int | None = None, weights=(1.0, 0.05, 0.05), rule: str = "norm", group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most max_tokens. pieces must be stable: a table or a checkpoint."""
    spark = pieces.sparkSession
    prepare(spark)
    max_docs, max_cost = max_docs or max_tokens, max_cost or max_tokens**2
    #: A full piece is a sequence of its own and needs no packing.
    full = (F.col("length") == max_tokens) & F.lit(max_cost >= max_tokens**2)
    alone = pieces.filter(full).withColumn("sequence_id", F.monotonically_increasing_id() * 4).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.filter(~full)

    def packer(tag: int, keep_bins: float):
        def run(batches):
            schema, serial, held, rows = arrow_schema(PACKED + ", again boolean"), 0, [], 0
            from pyspark import TaskContext

            base = TaskContext.get().partitionId() << 33

            def flush():
                nonlocal serial
                t = pa.Table.from_batches(held)
                lengths = t.column("length").to_numpy()
                b, off, n = best_fit(lengths, max_tokens, max_docs, max_cost, weights, rule)
                fill = np.bincount(b, weights=lengths, minlength=n)
                again = fill[b] < keep_bins * max_tokens
                cols = [t.column(c).combine_chunks() for c in PACKED.replace(" long", "").replace(" int", "").split(", ")[:5]]
                ids = (base + serial + b) * 4 + tag
                serial += n
                return pa.RecordBatch.from_arrays([*cols, pa.array(ids), pa.array(off), pa.array(again)], schema=schema)

            for batch in batches:
                at = 0
                while at < batch.num_rows:
                    part = batch.slice(at, group - rows)
                    held.append(part)
                    rows, at = rows + part.num_rows, at + part.num_rows
                    if rows >= group:
                        yield flush()
                        held, rows = [], 0
            if held:
                yield flush()

        return run

    def dealt(df: DataFrame, n: int) -> DataFrame:
        return df.repartition(max(1, math.ceil(n / group))).sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "length", "ids_crc32")

    first = checkpointed(dealt(rest, rest.count()).mapInArrow(packer(1, 0.97), PACKED + ", again boolean"))
    loose = first.filter("again").select(*[x.split()[0] for x in PIECES.split(", ")])
    second = dealt(loose, loose.count()).mapInArrow(packer(2, 0.0), PACKED + ", again boolean")
    return alone.unionByName(first.filter("not again").drop("again")).unionByName(second.drop("again"))


def longest_piece(max_tokens: int = MAX_TOKENS, max_cost: int | None = None, **_) -> int:
    """Tokens that an empty sequence can hold in one piece."""
    return max(1, min(max_tokens, math.isqrt(max_cost or max_tokens**2)))


def pack_documents(docs: DataFrame, path: str, **limits) -> DataFrame:
    return pack_pieces(checkpointed(cut_documents(docs, path, longest_piece(**limits))), **limits)
