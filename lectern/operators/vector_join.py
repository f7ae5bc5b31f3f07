"""The nearest pages of many questions at once, each question within its own document.

Pages and questions lie in packs of one document each; packs of a document meet in pairs, a matrix product for each, and every pairing leaves the best few of each question. Pages are dealt to
packs by hash, as many as the document's pages need, so a document with a third of all pages is many packs, and a pair of packs is what travels: neither the pages of a document nor
its questions gather in a task, and no pair of a page and a question becomes a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from ..functions.vectors import DIGITS

#: Rows in a pack, about.
PAGES, QUESTIONS = 2048, 512


def packed(rows: DataFrame, key: str, size: int) -> DataFrame:
    """document_id, pack, packs, keys (array), data (float64 of unit vectors, row by row), dims: the usable vectors of rows (key, document_id, vector). Vectors of different lengths lie in different packs."""
    usable = rows.filter("document_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0 AND exists(vector, x -> x <> 0) AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    usable = usable.select(F.col(key).alias("key"), "document_id", "vector", F.size("vector").alias("dims"))
    sizes = usable.groupBy("document_id", "dims").agg(F.ceil(F.count(F.lit(1)) / size).alias("packs"))
    dealt = usable.join(sizes, ["document_id", "dims"]).withColumn("pack", F.pmod(F.xxhash64("key"), F.col("packs")))
    # a pack has about `size` rows
    held = dealt.groupBy("document_id", "dims", "pack", "packs").agg(F.collect_list(F.struct("key", "vector")).alias("rows"))
    return held


def nearest(questions: DataFrame, pages: DataFrame, limit: int, floor: float, question_pack: int = QUESTIONS, page_pack: int = PAGES) -> DataFrame:
    """question, page_id, similarity: for each row of questions (question, document_id, vector) the `limit` rows of pages (page_id, document_id, vector) of its document that are most
    similar by cosine, at least floor; ties go to the smaller page_id. Null vectors, zero vectors and those of another length are similar to nothing, as in
    `vectors.cosine`. Rows with the same question share one list."""
    left, right = packed(questions, "question", question_pack), packed(pages, "page_id", page_pack)
    # each pack of questions goes to every pack of its document's pages, which are known by number
    counts = right.groupBy("document_id", "dims").agg(F.max("packs").alias("_n"))
    sent = left.join(counts, ["document_id", "dims"]).select("document_id", "dims", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("pack"), F.col("rows").alias("asked"))
    pairs = sent.join(right.select("document_id", "dims", "pack", "rows"), ["document_id", "dims", "pack"]).select("asked", "rows")
    kinds = StructType([StructField("question", questions.schema["question"].dataType), StructField("page_id", pages.schema["page_id"].dataType)]).add("similarity", "double")
    from pyspark.sql.pandas.types import to_arrow_schema

    def unit(rows: pa.StructScalar):
        keys, vectors = zip(*((r["key"], r["vector"]) for r in rows.as_py()), strict=True)
        m = np.array(vectors, np.float64)
        return keys, m, np.sqrt((m * m).sum(1))

    def run(batches):
        schema = to_arrow_schema(kinds)
        for batch in batches:
            for asked, held in zip(*batch.columns, strict=True):
                (qs, q, q_length), (ids, m, length) = unit(asked), unit(held)
                order = np.array(sorted(range(len(ids)), key=ids.__getitem__))  # so that a stable sort breaks ties
                similarity = np.round((q @ m[order].T) / np.outer(q_length, length[order]), DIGITS)
                out = []
                for k, row in zip(qs, similarity, strict=True):
                    may = np.flatnonzero(row >= floor)
                    if len(may) > limit:
                        may = may[row[may] >= np.partition(row[may], -limit)[-limit]]
                    best = may[np.argsort(-row[may], kind="stable")[:limit]]
                    out += [(k, ids[order[j]], float(row[j])) for j in best]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    found = pairs.mapInArrow(run, kinds)
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("similarity"), "page_id"))
    return found.withColumn("_n", place).filter(F.col("_n") <= limit).drop("_n")
