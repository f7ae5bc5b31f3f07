"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a few differing bits, grouped by reachability.

Equal fingerprints are one. Fingerprints that differ in at most RADIUS (3) bits agree on one of four blocks of 16 bits, and of
the 48 others on one of four blocks of 12: each fingerprint goes to 16 buckets of 28 agreed bits, and every link lies in
a bucket. Buckets of more than SPLIT fingerprints are divided again in the same way, on the bits they have left, so none stays large. Within a
bucket distances are computed bit-sliced: bit planes stored vertically, 64 fingerprints to a word; differences are counted
in carry-save counters of two bits and an overflow bit, and blocks in which all have overflowed are abandoned. A bucket yields a
spanning forest, never all its pairs; components are found over these links.

Results: null, empty and wordless texts have fingerprint zero and are linked like any other. A text of one or two words is one
shingle. component_id is the smallest doc_id reachable; null ids count as larger than any (a component of null ids alone has a null
component_id). Repeated rows and ids stay rows of their own; a fingerprint or component of very many rows is not shuffled. Very long texts are read whole. Other columns are ignored, or pass through keep_one.
A bit that exactly half of the hashes set is 0. An empty table gives an empty one. A last bucket holds 2^20 fingerprints at most and is compared in whole, quadratic in its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, arrow_schema, checkpointed, fresh, prepare, skew_join, words
from .components import connected_components

RADIUS = 3
SHINGLE = 3

#: Fingerprints in a bucket beyond which it is divided again.
SPLIT = 2048

#: Buckets agree on more and more bits; after the last level at most 20 bits are free.
LEVELS = 5

#: Rows that every task is told to drop at most.
SEND_ROWS = 1_000_000


def fingerprint(found: list[bytes], size: int = SHINGLE) -> int:
    """The bits set in more than half of the shingles' hashes."""
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= size:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(found) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The id columns (long) and fp, the fingerprint as a signed long."""
    prepare(docs.sparkSession)
    ddl = ", ".join(f"{c} long" for c in (*id_cols, "fp"))

    def run(batches):
        schema = arrow_schema(ddl)
        for batch in batches:
            fps = np.fromiter((fingerprint(words(x)) for x in batch.column("text").to_pylist()), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in id_cols), pa.array(fps)], schema=schema)

    return docs.select(*(F.col(c).cast("long").alias(c) for c in id_cols), "text").mapInArrow(run, ddl)


def masks(level: int) -> list[int]:
    """The bits that the buckets of each path of a level agree on, as signed longs; path p of a level comes from path p // 4 of the level before."""
    paths: list[tuple[int, list[int]]] = [(0, list(range(64)))]
    for _ in range(level):
        paths = [(mask | sum(1 << int(b) for b in block), [b for b in free if b not in set(block.tolist())]) for mask, free in paths for block in np.array_split(np.array(free), RADIUS + 1)]
    return [int(np.array([mask], np.uint64).view(np.int64)[0]) for mask, _ in paths]


def within(fps: np.ndarray, radius: int = RADIUS, block: int = 512) -> np.ndarray:
    """For each fingerprint of a bucket, the place of the first member of its linked group in the bucket."""
    n = len(fps)
    label = np.arange(n)
    width = -(-n // 64)
    bits = np.zeros((width * 64, 64), np.uint8)
    bits[:n] = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)  # 64 planes of one bit for each fingerprint
    varied = [k for k in range(64) if 0 < bits[:n, k].sum() < n]  # agreed planes differ nowhere
    real = np.full(width, ~np.uint64(0))
    if n % 64:
        real[-1] = np.uint64((1 << (n % 64)) - 1)
    for at in range(0, n, block):
        rows = np.arange(at, min(at + block, n))
        words = np.arange(at // 64, width)  # earlier pairs were seen from the other side
        shape = (len(rows), len(words))
        low, high, over = (np.zeros(shape, np.uint64) for _ in range(3))
        over |= ~real[words]
        own = rows // 64 - at // 64  # nor are the row itself and the ones before it sought
        over[np.arange(len(words)) < own[:, None]] = ~np.uint64(0)
        over[np.arange(len(rows)), own] |= ~np.uint64(0) >> (63 - rows % 64).astype(np.uint64)
        for step, k in enumerate(varied):
            differ = planes[k, words] ^ np.where(bits[rows, k] > 0, ~np.uint64(0), np.uint64(0))[:, None]
            carry = low & differ
            low ^= differ
            over |= high & carry
            high ^= carry
            if step % 8 == 7 and step + 1 < len(varied):
                left = over != ~np.uint64(0)
                live, some = left.any(axis=1), left.any(axis=0)
                if not live.all() or not some.all():
                    rows, words = rows[live], words[some]
                    low, high, over = (x[np.ix_(live, some)] for x in (low, high, over))
                    if not len(rows):
                        break
        if radius < 3:
            over |= high & (low if radius == 2 else ~np.uint64(0))
        if not len(rows):
            continue
        near = np.unpackbits(np.ascontiguousarray(~over).view(np.uint8), axis=1, bitorder="little")
        i, j = np.nonzero(near)
        label = _joined(label, rows[i], words[j // 64] * 64 + j % 64)
    return label


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the links i-j: hooks the larger of two roots on the smaller until no link crosses."""
    while True:
        a, b = label[i], label[j]
        cross = a != b
        if not cross.any():
            return label
        i, j = i[cross], j[cross]
        np.minimum.at(label, np.maximum(a[cross], b[cross]), np.minimum(a[cross], b[cross]))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _agreed(level: int):
    return F.expr(f"fp & element_at(array({', '.join(f'{m}L' if m != -(1 << 63) else 'cast(-9223372036854775808 as bigint)' for m in masks(level))}), path + 1)")


def links(distinct: DataFrame, split: int = SPLIT) -> DataFrame:
    """Links (a, b) between different fingerprints, enough for every component; distinct has a stable column fp without repeats."""
    prepare(distinct.sparkSession)
    found, level = None, 2
    rows = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("path"))
    while True:
        bucket = _agreed(level)
        if level < LEVELS:
            hot = rows.groupBy("path", bucket.alias("agreed")).count().filter(F.col("count") > split).select("path", "agreed")
            hot = checkpointed(hot)
            more = not hot.isEmpty()
        else:
            more = False
        cold = rows
        if more:
            keyed = rows.withColumn("agreed", bucket)
            cold = keyed.join(hot, ["path", "agreed"], "left_anti").select("fp", "path")
        part = _linked(cold, level)
        found = part if found is None else found.unionByName(part)
        if not more:
            return found
        rows = keyed.join(hot, ["path", "agreed"], "left_semi").select("fp", F.explode(F.sequence(F.col("path") * 4, F.col("path") * 4 + 3)).alias("path"))
        level += 1


def _linked(rows: DataFrame, level: int) -> DataFrame:
    of = np.array(masks(level), np.int64)

    def run(batches):
        schema = arrow_schema("a long, b long")

        def solve(path, fp):
            """Links of whole buckets, given in order."""
            same = np.empty(len(fp), bool)
            agreed = fp & of[path]
            same[0] = False
            same[1:] = (path[1:] == path[:-1]) & (agreed[1:] == agreed[:-1])
            edges = np.append(np.flatnonzero(~same), len(fp))
            big = np.flatnonzero(np.diff(edges) > 1)
            a, b = [], []
            for k in big:
                own = fp[edges[k] : edges[k + 1]]
                label = within(own.view(np.uint64))
                hung = np.flatnonzero(label != np.arange(len(own)))
                a.append(own[hung])
                b.append(own[label[hung]])
            if a:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=schema)

        held_path, held_fp = np.empty(0, np.int64), np.empty(0, np.int64)
        waiting, size = [], 0
        for batch in batches:
            waiting.append((batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size < 50_000:
                continue
            path, fp = np.concatenate([held_path, *(w[0] for w in waiting)]), np.concatenate([held_fp, *(w[1] for w in waiting)])
            waiting, size = [], 0
            last = np.flatnonzero((path != path[-1]) | ((fp & of[path]) != (fp[-1] & of[path[-1]])))
            cut = last[-1] + 1 if len(last) else 0  # the last bucket may go on
            if cut and (out := solve(path[:cut], fp[:cut])) is not None:
                yield out
            held_path, held_fp = path[cut:], fp[cut:]
        path, fp = np.concatenate([held_path, *(w[0] for w in waiting)]), np.concatenate([held_fp, *(w[1] for w in waiting)])
        if len(fp) and (out := solve(path, fp)) is not None:
            yield out

    bucket = _agreed(level)
    return rows.select("path", "fp").repartition(F.col("path"), bucket).sortWithinPartitions(F.col("path"), bucket, F.col("fp")).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, split: int = SPLIT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document."""
    prints = checkpointed(fingerprints(docs))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))
    parts = connected_components(links(distinct.select("fp"), split), hot_rows).withColumnRenamed("node", "fp")
    named = distinct.join(parts, "fp", "left").select("fp", "doc_id", "n", F.coalesce("component", "fp").alias("component"))
    first = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("m"))
    sizes = distinct.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    of = skew_join(named, first, "component", "m", sizes[0], hot_rows).select("fp", "component_id", "n")
    return skew_join(prints, of, "fp", "n", sizes[1], hot_rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, split: int = SPLIT, send_rows: int = SEND_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the smallest doc_id, the first of several such rows.

    The rows to drop are known by number. While they are at most send_rows (8 bytes each) every task gets them, and texts stay where they are; beyond
    that they meet the texts in a shuffled join.
    """
    place = fresh(docs, "place")
    numbered = checkpointed(docs.withColumn(place, F.monotonically_increasing_id()))
    prints = checkpointed(fingerprints(numbered.select("doc_id", "text", F.col(place).alias("row")), ("doc_id", "row")))
    chosen = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    distinct = checkpointed(prints.groupBy("fp").agg(chosen, F.count("*").alias("n")))
    parts = connected_components(links(distinct.select("fp"), split), hot_rows).withColumnRenamed("node", "fp")
    named = distinct.join(parts, "fp", "left").select("fp", "n", F.coalesce("component", "fp").alias("component"), "first")
    kept = named.groupBy("component").agg(F.min("first").alias("first"), F.count("*").alias("m"))
    sizes = distinct.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    of = skew_join(named.select("fp", "n", "component"), kept, "component", "m", sizes[0], hot_rows).select("fp", "n", F.col("first.row").alias("kept"))
    dropped = checkpointed(skew_join(prints, of, "fp", "n", sizes[1], hot_rows).filter("row <> kept").select(F.col("row").alias(place)))
    sent = F.broadcast(dropped) if dropped.count() <= send_rows else dropped
    return numbered.join(sent, place, "left_anti").select(*docs.columns)
