"""A full-text index that is stored and follows the writes: posting lists with positions, in buckets of lexemes, a batch for each write.

    path/postings/batch=<n>/bucket=<b>   lexeme, field, config, page_id, positions, tf; sorted by these, so row groups of other lexemes are skipped
    path/written/batch=<n>               page_id: the pages that a batch has written, also those that it has removed or emptied

A posting counts if no later batch has written its page (`plans.batches`), and no write touches the files of another batch. Readers list the buckets of a query's lexemes alone. `compacted` writes all that counts as a single batch elsewhere.

Originals are indexed in the simple configuration, translations in the one of their document's language (`search.indexed`); texts are analysed when they are written, and queries run without Python.
Frequent lexemes have long lists: writers cut a bucket into files by size, whatever lexemes they hold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, text
from ..plans import batches
from ..plans.arrow import short_batches
from . import search

#: Buckets of lexemes. A bucket is a folder of each batch.
BUCKETS = 64

ORIGINAL, TRANSLATED = 0, 1

#: Bytes of the tokens, as Arrow, whose postings are packed together: what a writer's worker holds, times about ten.
PACK_BYTES = 16 << 20

COLUMNS = "lexeme string, field int, config string, positions array<int>, tf int, bucket int"


def cover_density(places: Column, n_terms: int, weight: float = 0.1) -> Column:
    """text.cover_density of an array<array<int>> column, the places of each term, as an expression.

    Places of all terms are gone through in order. The state has, for each term, the number and the place of its last occurrence; a cover ends where the earliest of these is a
    later one than at the last cover.
    """
    events = F.array_sort(F.flatten(F.transform(places, lambda own, k: F.transform(own, lambda at: F.struct(at.cast("int").alias("at"), k.cast("int").alias("k"))))))
    none = F.array_repeat(F.lit(-1), n_terms)
    start = F.struct(F.lit(0).alias("n"), none.alias("number"), none.alias("place"), F.lit(-1).alias("last"), F.lit(0.0).alias("total"))

    def step(s: Column, e: Column) -> Column:
        number = F.transform(s["number"], lambda x, k: F.when(k == e["k"], s["n"]).otherwise(x))
        place = F.transform(s["place"], lambda x, k: F.when(k == e["k"], e["at"]).otherwise(x))
        first = F.array_min(number)
        more = first > s["last"]  # -1 while a term has not been met
        gap = e["at"] - F.array_min(place) - (s["n"] - first)
        total = s["total"] + F.when(more, F.lit(weight) / (F.lit(1) + gap)).otherwise(F.lit(0.0))
        return F.struct((s["n"] + 1).alias("n"), number.alias("number"), place.alias("place"), F.when(more, first).otherwise(s["last"]).alias("last"), total.alias("total"))

    return F.aggregate(events, start, step, lambda s: s["total"])


def _listed(ids: pa.Array, token_lists: pa.Array, configs: pa.Array, field: int, buckets: int, stop: dict[str, list[str]]) -> pa.RecordBatch:
    """The postings of one field of some pages, a row for each lexeme and configuration, by bucket: each word is analysed once, and one sort brings its places in a page together."""
    lengths = np.diff(token_lists.offsets.to_numpy())
    words = pc.dictionary_encode(token_lists.flatten())
    row = np.repeat(np.arange(len(ids)), lengths)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    config = pc.dictionary_encode(configs)
    names, vocabulary = config.dictionary.to_pylist(), words.dictionary.to_pylist()
    pair = config.indices.to_numpy()[row].astype(np.int64) * len(vocabulary) + words.indices.to_numpy()
    pairs, which = np.unique(pair, return_inverse=True)
    of = [text.lexemes_of(c, stop.get(c, [])) for c in names]
    found = [(of[p // len(vocabulary)][vocabulary[p % len(vocabulary)]], p // len(vocabulary)) for p in pairs.tolist()]
    bucket = {x: zlib.crc32(x.encode()) % buckets for x, _ in found}
    ordered = sorted(set(found), key=lambda x: (bucket[x[0]], x))
    place = {x: k for k, x in enumerate(ordered)}
    code = np.array([place[x] for x in found], np.int64)[which]
    kept = np.array([x != "" for x, _ in ordered], bool)[code]  # stop words
    key, at = code[kept] * len(ids) + row[kept], at[kept]
    order = np.argsort(key, kind="stable")  # places of a page stay in order
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))  # of each posting
    whose = key[first] // len(ids)
    head = np.flatnonzero(np.diff(whose, prepend=-1))  # of each row
    ends = lambda starts, n: np.append(starts, n).astype(np.int32)
    by_row = lambda values: pa.ListArray.from_arrays(ends(head, len(first)), values)
    tfs = by_row(pa.array(np.diff(np.append(first, len(key))).astype(np.int32)))
    begin = first[head]
    places = pa.ListArray.from_arrays(ends(begin, len(key)), pa.array(at[order].astype(np.int32)))
    starts = by_row(pa.array((first - np.repeat(begin, np.diff(np.append(head, len(first)))) + 1).astype(np.int32)))
    page_ids = by_row(ids.take(pa.array(key[first] % len(ids))))
    mine = [ordered[k] for k in whose[head].tolist()]
    columns = [pa.array([bucket[x] for x, _ in mine], pa.int32()), pa.array([x for x, _ in mine], pa.string()), pa.array([field] * len(mine), pa.int32()), pa.array([names[c] for _, c in mine], pa.string()), page_ids, starts, tfs, places]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "lexeme", "field", "config", "page_ids", "starts", "tfs", "places"])


def packed(pages: DataFrame, documents: DataFrame, buckets: int) -> DataFrame:
    """bucket, lexeme, field, config, page_ids, starts, tfs, places: the postings of some hundred pages at a time, those of a lexeme in one row, their places one after the other.

    A page is a row, so its postings are made where it lies and words are not exchanged; packed like this, postings travel in a few bytes each.
    """
    short_batches(pages.sparkSession)
    found = pages.join(documents.select("document_id", "target_language"), "document_id", "left")
    config = labels.fts_config(F.coalesce("target_language", F.lit("en")))
    ready = found.select("page_id", config.alias("config"), *(text.tokens(F.col(c)).alias(c) for c in ("original_markdown", "translated_markdown")))
    stop = {c: sorted(text.stop_words(c)) for c in search.CONFIGS}

    def listed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, configs, original, translated = (c.combine_chunks() for c in pa.Table.from_batches(held).columns)
        simple = pa.array(["simple"] * len(ids), pa.string())
        for field, lists, of in ((ORIGINAL, original, simple), (TRANSLATED, translated, configs)):
            if len(lists.flatten()):
                yield _listed(ids, lists, of, field, buckets, stop)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= PACK_BYTES:
                yield from listed(held)
                held, size = [], 0
        if held:
            yield from listed(held)

    return ready.mapInArrow(run, f"bucket int, lexeme string, field int, config string, page_ids array<{dict(pages.dtypes)['page_id']}>, starts array<int>, tfs array<int>, places array<int>")


def unpacked(packs: DataFrame) -> DataFrame:
    """A row for each posting of packed ones."""
    rows = packs.select("bucket", "lexeme", "field", "config", "places", F.inline(F.arrays_zip("page_ids", "starts", "tfs")))
    return rows.select("bucket", "lexeme", "field", "config", F.col("page_ids").alias("page_id"), F.slice("places", F.col("starts"), F.col("tfs")).alias("positions"), F.col("tfs").alias("tf"))


def postings_of(pages: DataFrame, documents: DataFrame, buckets: int) -> DataFrame:
    """bucket, lexeme, field, config, page_id, positions, tf of all texts of pages; stop words have none. A page_id that pages have twice has postings for each."""
    return unpacked(packed(pages, documents, buckets))


def bucket_of(lexeme: Column, buckets: int) -> Column:
    return (F.crc32(lexeme.cast("binary")) % buckets).cast("int")


class TextIndex(NamedTuple):
    """An index in a folder that all executors share."""

    path: str
    buckets: int = BUCKETS

    def write(self, pages: DataFrame, documents: DataFrame, batch: int, removed: DataFrame | None = None) -> None:
        """Writes pages, with their whole texts, as a batch, and takes out those of removed (page_id). The first batch builds the index."""
        lists = unpacked(packed(pages, documents, self.buckets).hint("rebalance", "bucket")).sortWithinPartitions("bucket", "lexeme", "field", "config", "page_id")
        lists.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/batch={batch}")
        gone = pages.select("page_id") if removed is None else pages.select("page_id").unionByName(removed.select("page_id"))
        batches.finish(gone, self.path, batch)

    def postings(self, spark: SparkSession, lexemes: list[str] | None = None) -> DataFrame:
        """The postings that count, with their batch; of some lexemes only, from their buckets."""

        def only(rows: DataFrame) -> DataFrame:
            if lexemes is None:
                return rows
            return rows.filter(F.col("bucket").isin(sorted({zlib.crc32(x.encode()) % self.buckets for x in lexemes}))).filter(F.col("lexeme").isin(lexemes))

        return batches.current(spark, self.path, "postings", "page_id", COLUMNS, only)

    def frequencies(self, spark: SparkSession, lexemes: list[str] | None = None) -> DataFrame:
        """lexeme, config, pages, occurrences."""
        return self.postings(spark, lexemes).groupBy("lexeme", "config").agg(F.count_distinct("page_id").alias("pages"), F.sum("tf").alias("occurrences"))

    def matches(self, spark: SparkSession, query: str) -> DataFrame:
        """page_id, fts_score: the pages with all terms of a query in one of their texts, and their cover densities, both texts' added up."""
        of = {"simple": text.query_terms(query)} | {c: text.query_terms(query, c) for c in search.CONFIGS}
        wanted = sorted({t for terms in of.values() for t in terms})
        if not wanted:
            return spark.createDataFrame([], f"page_id {dict(self.postings(spark, []).dtypes)['page_id']}, fts_score double")
        found = self.postings(spark, wanted)
        # a row is asked for if its lexeme is a term of its configuration, whose number it then has
        number = F.lit(None).cast("int")
        for c, terms in of.items():
            for k, t in enumerate(terms):
                number = F.when((F.col("config") == c) & (F.col("lexeme") == t), k).otherwise(number)
        n_terms = F.create_map(*(x for c, terms in of.items() for x in (F.lit(c), F.lit(len(terms)))))
        hits = found.withColumn("_k", number).filter("_k IS NOT NULL")
        # as many rows a group as the query has terms, or more if a page was written twice in a batch
        texts = hits.groupBy("page_id", "field", "config").agg(F.collect_list(F.struct("_k", "positions")).alias("all"))
        of_term = lambda k: F.array_sort(F.flatten(F.transform(F.filter("all", lambda x: x["_k"] == k), lambda x: x["positions"])))
        own = F.transform(F.array_sort(F.array_distinct(F.transform("all", lambda x: x["_k"]))), of_term)
        texts = texts.withColumn("own", own).filter(F.size("own") == n_terms[F.col("config")])
        places = F.col("own")
        score = F.lit(None).cast("double")
        for n in sorted({len(terms) for terms in of.values()} - {0}):
            score = F.when(F.size("own") == n, F.size(places[0]) * F.lit(0.1) if n == 1 else cover_density(places, n)).otherwise(score)
        return texts.groupBy("page_id").agg(F.round(F.sum(score), 9).alias("fts_score"))

    def text_scores(self, pages: DataFrame, documents: DataFrame, query: str) -> DataFrame:
        """search.text_scores from the index: no text of pages is read."""
        return search.searchable(pages, documents).select("page_id", "document_id").join(self.matches(pages.sparkSession, query), "page_id")

    def compacted(self, spark: SparkSession, path: str) -> TextIndex:
        """All that counts as batch 0 of an index elsewhere; this one stays as it is."""
        out = TextIndex(path, self.buckets)
        self.postings(spark).drop("batch").hint("rebalance", "bucket").sortWithinPartitions("bucket", "lexeme", "field", "config", "page_id").write.partitionBy("bucket").parquet(f"{path}/postings/batch=0")
        batches.finish(batches.read(spark, self.path, "written", batches.done(spark, self.path)).select("page_id"), path, 0)
        return out
