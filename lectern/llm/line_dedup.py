"""Removal of lines that many documents share.

1. Every task sends the 64-bit hashes of its documents' line keys, each once for some rows with the number of documents, to the segment of the hash; segments are ranges
   of hashes and their number follows the number of lines, so none grows with the data. A segment folds what it gets into two Bloom filters, seen once and
   seen twice or more, which it sizes by what it holds. There are no false negatives: what comes again is known to the first filter and enters the second one.
   Only hashes that the second one knows are counted; those in enough documents are suspected. A false positive costs a counter, never a wrong result.
2. Lines whose hash is suspected, and no others, leave their tasks whole, as (key, hash, documents, first row) summed within the task. Their exact sums by key
   decide, and show which hashes several keys share.
3. The lines of keys found in enough documents go, all of them or (keep_first) all but the first line of the first row that has the key. Suspected hashes reach every task while they are few
   by a bound on their exact size. Beyond it no task gets them all: each segment answers for each run of rows which of its hashes are suspected, and rows and answers meet by the
   run's number. A line in very many documents is one hash in each run, so it makes no task hot.

A row is a document. A key is a line stripped of ASCII white space at both ends with A-Z in lower case. Results: a null or
empty text is one empty line; empty keys (shorter than min_chars) are never removed; a key counts once for each document, however
often the document repeats it. Rows with equal ids count as documents of their own; the first row is the first as rows lie in docs, so ties do not arise. Very long texts are
split whole; what a task holds back is bounded by bytes, not by texts. An empty table stays empty. Other columns pass or are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, arrow_schema, checkpointed, climbed, fresh, numbers, planes, prepare, steps

#: Lines of a segment, about; segments at least.
SEGMENT, LEAST_SEGMENTS = 1 << 22, 16

#: Hashes that a task holds before it sends them, bytes of keys likewise.
HELD, HELD_BYTES = 1 << 21, 32 << 20

#: Suspected hashes are sent to every task while their exact total size is below this.
SEND_BYTES = 16 << 20

#: A run has two to the power of this many rows.
RUN = 10


def keys_of(raw: bytes, min_chars: int) -> list[bytes | None]:
    """A key for each line, None where it is too short to be removed."""
    found = [line.strip(ASCII_SPACE).lower() for line in raw.split(b"\n")]
    if min_chars <= 1:
        return [k or None for k in found]
    return [k if len(k) >= min_chars and len(k.decode()) >= min_chars else None for k in found]


def hashes_of(keys: list[bytes | None], seed: int = 0, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The places of the lines that have a key, and the keys' hashes; only tests want fewer than 64 bits."""
    at = np.array([k for k, x in enumerate(keys) if x is not None], np.int64)
    h = np.fromiter(map(partial(xxhash.xxh3_64_intdigest, seed=seed), (x for x in keys if x is not None)), np.uint64, len(at))
    return at, h & np.uint64((1 << 64) - (1 << (64 - bits)))


def line_count(docs: DataFrame) -> int:
    text = F.coalesce("text", F.lit(""))
    return docs.select((F.length(text) - F.length(F.translate(text, "\n", "")) + 1).alias("n")).agg(F.sum("n")).first()[0] or 0


PARCEL = "segment int, run long, hashes binary, documents binary"


def parcels(docs: DataFrame, place: str | None, segments: int, min_chars: int, seed: int, bits: int) -> DataFrame:
    """The distinct hashes of some rows and in how many of these each is, by segment. With place, the rows are of one run."""

    def run(batches):
        schema = arrow_schema(PARCEL)
        held, n, here = [], 0, None

        def flush():
            h, documents = np.unique(np.concatenate(held), return_counts=True)
            ends = np.searchsorted((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32), np.arange(segments + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(ends)).tolist()
            cols = [some, [here] * len(some), [steps(h[ends[s] : ends[s + 1]]) for s in some], [planes(documents[ends[s] : ends[s + 1]].astype(np.uint32)) for s in some]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for row, text in zip(batch.column(1).to_pylist() if place else [None] * batch.num_rows, batch.column(0).to_pylist(), strict=True):
                now = None if row is None else row >> RUN
                if n >= HELD or n and now != here:
                    yield flush()
                    held, n = [], 0
                here = now
                _, h = hashes_of(keys_of((text or "").encode(), min_chars), seed, bits)
                if len(h):
                    held.append(np.unique(h) if len(h) > 1 else h)
                    n += len(held[-1])
        if n:
            yield flush()

    return docs.select("text", *([place] if place else [])).mapInArrow(run, PARCEL)


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """Two filter positions for each hash: an array of shape (2, number of hashes). High bits choose the segment, low ones the position."""
    return np.stack((h, (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20))) & np.uint64(bits - 1)


def _get(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool).all(axis=0)


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at.reshape(-1) >> np.uint64(3), np.left_shift(1, at.reshape(-1) & np.uint64(7)).astype(np.uint8))


class Segment:
    """The parcels of one segment and its two filters."""

    def __init__(self, held: list[tuple[int | None, bytes, bytes]], bits: int | None = None):
        self.held = held
        total = sum(len(numbers(documents, np.uint32)) for _, _, documents in held)
        self.bits = bits or 1 << max(13, (8 * total - 1).bit_length())
        self.once, self.twice = np.zeros(self.bits // 8, np.uint8), np.zeros(self.bits // 8, np.uint8)
        for _, h, documents in self.parcels():
            at = places(h, self.bits)
            _set(self.twice, at[:, _get(self.once, at) | (documents > 1)])
            _set(self.once, at)  # the hashes of a parcel are distinct

    def parcels(self) -> Iterator[tuple[int | None, np.ndarray, np.ndarray]]:
        for run, h, documents in self.held:
            yield run, climbed(h), numbers(documents, np.uint32)

    def suspected(self, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes in at least min_docs documents, ascending, and their numbers of documents."""
        h, n, waiting = np.empty(0, np.uint64), np.empty(0, np.int64), []

        def summed():
            every = np.concatenate((h, *(x for x, _ in waiting)))
            keys, of = np.unique(every, return_inverse=True)
            return keys, np.bincount(of, np.concatenate((n, *(x for _, x in waiting))), len(keys)).astype(np.int64)

        for _, x, documents in self.parcels():
            again = np.ones(len(x), bool) if min_docs < 2 else _get(self.twice, places(x, self.bits))
            waiting.append((x[again], documents[again]))
            if sum(len(x) for x, _ in waiting) > HELD:
                (h, n), waiting = summed(), []
        h, n = summed()
        return h[n >= min_docs], n[n >= min_docs]


def suspected_hashes(sent: DataFrame, min_docs: int) -> DataFrame:
    """(h long, n long): the suspected hashes, as signed numbers, and their numbers of documents."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = Segment([x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("run", "hashes", "documents")), strict=True)]).suspected(min_docs)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return sent.groupBy("segment").applyInArrow(run, "h long, n long")


def answers(sent: DataFrame, min_docs: int) -> DataFrame:
    """(run long, hashes binary): of each run the suspected hashes, by segment."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segment([x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("run", "hashes", "documents")), strict=True)])
        known, _ = segment.suspected(min_docs)
        for of, h, _ in segment.parcels():
            h = h[among(h, known)]
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([steps(h)], pa.binary())], ["run", "hashes"])

    return sent.groupBy("segment").applyInArrow(run, "run long, hashes binary")


def among(h: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(h), bool)
    at = np.searchsorted(ascending, h)
    return ascending[np.minimum(at, len(ascending) - 1)] == h


def marked_rows(numbered: DataFrame, place: str, answered: DataFrame, min_chars: int, seed: int, bits: int) -> DataFrame:
    """numbered with column marks, the ascending suspected hashes of the row's lines: a run's rows and its answers meet in one task, answers first."""
    run_no, kind, marks = (fresh(numbered, x) for x in ("run", "kind", "marks"))
    rows = numbered.withColumn(run_no, F.shiftright(place, RUN)).withColumn(kind, F.lit(1)).withColumn(marks, F.lit(None).cast("binary"))
    asked = answered.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in numbered.schema), F.col("run").alias(run_no), F.lit(0).alias(kind), F.col("hashes").alias(marks))
    schema = rows.drop(run_no, kind).schema

    def mark(batches):
        here, known, new = None, np.empty(0, np.uint64), []
        for batch in batches:
            names = batch.schema.names
            kinds, runs, given, texts = (batch.column(names.index(c)).to_pylist() for c in (kind, run_no, marks, "text"))
            out, kept = [], []
            for k in range(batch.num_rows):
                if runs[k] != here:
                    here, known, new = runs[k], np.empty(0, np.uint64), []
                if kinds[k] == 0:
                    new.append(climbed(given[k]))
                    continue
                if new:
                    known, new = np.sort(np.concatenate(new)), []
                h = np.unique(hashes_of(keys_of((texts[k] or "").encode(), min_chars), seed, bits)[1])
                out.append(h[among(h, known)].tobytes())
                kept.append(k)
            batch = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(f)) for f in schema.names[:-1]), pa.array(out, pa.binary())], names=schema.names)

    return rows.unionByName(asked).repartition(F.col(run_no)).sortWithinPartitions(run_no, kind).mapInArrow(mark, schema)


def suspects(rows: DataFrame, place: str | None, marks: str | None, sent, min_chars: int, seed: int, bits: int) -> DataFrame:
    """(key, h, n, first): the lines whose hash is suspected, with the number of documents and the first row. rows is (text, place, marks) as far as given."""
    ddl = "key binary, h long, n long, first long"

    def run(batches):
        schema = arrow_schema(ddl)
        n: Counter = Counter()
        of: dict = {}
        size = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([k for k in n], [of[k][0] for k in n], list(n.values()), [of[k][1] for k in n]), schema.types, strict=True)], schema=schema)

        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for k, text in enumerate(columns["text"]):
                known = np.frombuffer(columns[marks][k] or b"", np.uint64) if marks else sent.value
                if not len(known):
                    continue
                keys = keys_of((text or "").encode(), min_chars)
                at, h = hashes_of(keys, seed, bits)
                hit = among(h, known)
                for key, x in {keys[a]: x for a, x in zip(at[hit].tolist(), h[hit].view(np.int64).tolist(), strict=True)}.items():
                    if key not in of:
                        of[key] = (x, columns[place][k] if place else 0)
                        size += len(key) + 200
                    n[key] += 1
                if size > HELD_BYTES:
                    yield flush()
                    n, of, size = Counter(), {}, 0
        yield flush()

    chosen = rows.select("text", *(c for c in (place, marks) if c))
    return chosen.mapInArrow(run, ddl).groupBy("key", "h").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def remove_lines(docs: DataFrame, keep, schema: str | object, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, send_bytes: int = SEND_BYTES, seed: int = 0, bits: int = 64) -> DataFrame:
    """Applies keep(batch, texts) to docs, where texts are (lines, dropped lines, what stays) of each row."""
    prepare(docs.sparkSession)
    columns = docs.columns
    place, first = fresh(docs, "place"), fresh(docs, "first")
    segments = max(LEAST_SEGMENTS, -(-line_count(docs) // SEGMENT))
    numbered = checkpointed(docs.withColumn(place, F.monotonically_increasing_id())) if keep_first else None
    found = checkpointed(suspected_hashes(parcels(docs if numbered is None else numbered, None, segments, min_chars, seed, bits), min_docs))
    few = found.count() * (16 if keep_first else 8) <= send_bytes
    broadcast = docs.sparkSession.sparkContext.broadcast
    if few:
        marks, rows = None, docs if numbered is None else numbered
        sent = broadcast(np.sort(np.array([r.h for r in found.select("h").collect()], np.int64).view(np.uint64)))
    else:
        numbered = checkpointed(docs.withColumn(place, F.monotonically_increasing_id())) if numbered is None else numbered
        sent, marks = None, fresh(numbered, "marks")
        rows = checkpointed(marked_rows(numbered, place, answers(parcels(numbered, place, segments, min_chars, seed, bits), min_docs), min_chars, seed, bits))

    exact = checkpointed(suspects(rows, place if keep_first else None, marks, sent, min_chars, seed, bits))
    shared = exact.join(exact.groupBy("h").count().filter("count > 1").select("h"), "h")
    if shared.agg(F.coalesce(F.sum(F.length("key") + 100), F.lit(0))).first()[0] > max(send_bytes, SEND_BYTES):
        return remove_lines(docs, keep, schema, min_docs, min_chars, keep_first, send_bytes, seed + 1, bits)  # hashes of another seed fall together elsewhere
    shared = [(r.h, bytes(r.key), r.n, r.first) for r in shared.collect()]
    #: Keys whose hash is not theirs alone: whether they go is known by key.
    doubtful = broadcast((np.unique(np.array([r[0] for r in shared], np.int64).view(np.uint64)), frozenset(r[1] for r in shared if r[2] >= min_docs)))
    at_first = None
    if keep_first:
        stay = exact.filter(F.col("n") >= min_docs).select("first", "key")
        stay = checkpointed(stay.groupBy(F.col("first").alias(place)).agg(F.collect_list("key").alias(first)))
        rows = rows.join(stay, place, "left")
        at_first = first

    def strip(batches):
        mixed, gone = doubtful.value
        for batch in batches:
            names = batch.schema.names
            texts = []
            own_marks = batch.column(names.index(marks)).to_pylist() if marks else None
            own_first = batch.column(names.index(at_first)).to_pylist() if at_first else None
            for k, text in enumerate(batch.column(names.index("text")).to_pylist()):
                raw = (text or "").encode()
                keys = keys_of(raw, min_chars)
                at, h = hashes_of(keys, seed, bits)
                hit = among(h, np.frombuffer(own_marks[k] or b"", np.uint64) if marks else sent.value)
                drop = at[hit].tolist()
                if drop and len(mixed):
                    drop = [a for a, m in zip(drop, among(h[hit], mixed).tolist(), strict=True) if not m or keys[a] in gone]
                if drop and own_first and own_first[k]:
                    left = set(map(bytes, own_first[k]))
                    once = []
                    for a in drop:
                        if keys[a] in left:
                            left.discard(keys[a])
                        else:
                            once.append(a)
                    drop = once
                if drop:
                    out = frozenset(drop)
                    raw = b"\n".join(line for a, line in enumerate(raw.split(b"\n")) if a not in out)
                texts.append((len(keys), len(drop), raw))
            yield keep(batch.select(columns), texts)

    return rows.mapInArrow(strip, schema)


DIGEST = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def line_digests(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, **how) -> DataFrame:
    """For each document its numbers of lines and of dropped lines, and a hash of what stays."""

    def keep(batch, texts):
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t[0] for t in texts], pa.int64()), pa.array([t[1] for t in texts], pa.int64()), pa.array([hashlib.sha256(t[2]).hexdigest() for t in texts], pa.string())], schema=arrow_schema(DIGEST))

    return remove_lines(docs.selectExpr("cast(doc_id as long) doc_id", "text"), keep, DIGEST, min_docs, min_chars, **how)


def without_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, **how) -> DataFrame:
    """docs with the shared lines gone from text; a text that changes gets its new length as n_chars if there is such a column. No row is dropped."""

    def keep(batch, texts):
        cols = {name: batch.column(name) for name in batch.schema.names}
        old = batch.column("text").to_pylist()
        new = [t[2].decode() if t[1] else was for t, was in zip(texts, old, strict=True)]
        cols["text"] = pa.array(new, pa.string())
        if "n_chars" in cols:
            cols["n_chars"] = pa.array([len(b) if t[1] else was for t, b, was in zip(texts, new, batch.column("n_chars").to_pylist(), strict=True)], batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return remove_lines(docs, keep, docs.schema, min_docs, min_chars, **how)


#: DuckDB: the same result in SQL.
SQL = r"""
WITH lines AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), each AS (
  SELECT r, doc_id, i, ls[i] AS line,
         translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM lines)
), gone AS (
  SELECT k FROM each WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT each.*, gone.k IS NOT NULL AS dropped FROM each LEFT JOIN gone ON each.k = gone.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
