"""Exact top-k by integer inner product over an impact-ordered index, score at a time.

Candidates lie in chunks; each chunk is indexed once, and its index is stored with it. For every dimension its vectors are listed by value, so a run of
equal value is a posting segment, and for a query a segment's impact is the query's component times that value: from the largest impact on,
a dimension's segments are read from one end of its list. A query processes the segments of all dimensions by descending quantised impact,
level by level. A vector not yet met in a dimension cannot gain more there than the next impact, so the level bounds every
score from above. Scores of the most promising vectors, computed exactly, bound the k-th best from below. Processing
pauses at levels to test whether it may stop, and stops only when few vectors are left that can reach that bound; those are rescored exactly. The
chunks' best are merged by query. The query's own rows are no candidates from the start.

Queries come in blocks; every block of queries meets every chunk in a cell of its own (a stated query set against all rows, in
blocks), cells are dealt evenly by number, and of each pairing k rows a query leave the task. A chunk travels once for each block; blocks grow with the queries up
to BLOCK, once there are cells enough for all cores.

Results: components become floor(64 * x). Vectors that are null or hold null, NaN or infinite components take no part. Shorter vectors count as
padded with zeros. Ties go to the smaller vec_id, then arbitrarily among rows with the same id. Components that 32 bits do not hold, and scores that
64 bits do not hold, are clamped to the range. A query's own row is every row with its id; queries with the same id are
answered together, by one list of the k best of all their pairs. Rows with a null vec_id take no part. Vectors may be of any length,
and there are no texts. Empty vectors or queries give an empty table. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_schema, checkpointed, prepare

#: Candidates in a chunk and queries in a block, at most about so many: what one task holds.
CHUNK, BLOCK = 16384, 16384

#: Queries in a block at least, and cells for each core that are wanted before blocks grow.
LEAST_BLOCK, CELLS = 256, 3

#: Tasks over which cells are dealt at most.
TASKS = 20_000

#: Shares of the largest impact at which processing pauses to test whether it may stop.
STOPS = (0.5, 0.3, 0.2, 0.12, 0.07, 0.03, -0.03)

#: What one met dimension adds to a vector's sum, far above any gain; sums stay exact in doubles.
MET = float(1 << 40)

#: Processing stops once no more than this share of a chunk is left to rescore.
RESCORE = 0.15

FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: list, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = np.clip(np.floor(64.0 * np.asarray(v, np.float64)), -(2**31), 2**31 - 1)
    return out


PACK = "number long, n int, ids binary, data binary, listed binary"


def packs(vectors: DataFrame, rows: int, dims: int, indexed: bool) -> tuple[DataFrame, int]:
    """Vectors in numbered packs of about rows, and how many numbers there are. Rows are dealt in turn, so packs are full whatever the files were, and even if
    one id has very many rows. An indexed pack carries the order of its vectors in each dimension."""
    parts = -(-vectors.count() // rows) or 1

    def run(batches):
        from pyspark import TaskContext

        ids, held = [], []
        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            held.append(quantised(batch.column(1).to_pylist(), dims).astype(np.int32))
        if ids:
            data = np.concatenate(held)
            kind = np.uint16 if len(data) <= 1 << 16 else np.uint32
            listed = np.argsort(data, axis=0, kind="stable").T.astype(kind).tobytes() if indexed else b""
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([len(data)], pa.int32()), pa.array([np.concatenate(ids).astype(np.int64).tobytes()]), pa.array([data.tobytes()]), pa.array([listed])], schema=arrow_schema(PACK))

    return checkpointed(vectors.repartition(parts).mapInArrow(run, PACK)), parts


class ImpactIndex:
    """The posting segments of one chunk of vectors."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, listed: np.ndarray | None = None):
        """listed: by dimension the vectors' places, by ascending value."""
        self.ids, self.data = ids, data.astype(np.int64)
        self.reals = data.astype(np.float64)
        self.order = np.argsort(self.data, axis=0, kind="stable").T.copy() if listed is None else listed.astype(np.int64)
        self.values = np.take_along_axis(self.data, self.order.T, axis=0).T.astype(np.float64)
        self.exact = float(np.abs(self.data).max(initial=0))

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        most = self.exact * float(np.abs(q).max(initial=0)) * len(q)
        if most < 2**52:
            return (self.reals[at] @ q.astype(np.float64)).astype(np.int64)
        if most < 2**62:
            return self.data[at] @ q
        whole = self.data[at].astype(object) @ q.astype(object)
        return np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in whole], np.int64)

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and scores of the k best, in order."""
        others = np.flatnonzero(self.ids != query_id)
        at = self._possible(q, k, others) if len(others) > 4 * k else others
        score = self.scores(at, q)
        best = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at[best]], score[best]

    def _possible(self, q: np.ndarray, k: int, others: np.ndarray) -> np.ndarray:
        """Places of all vectors of others that can be among their k best, ties included; there are more than k others.

        At level t every segment of greater impact has been processed: gained holds what each vector got from them and met how
        many dimensions that were. Each other dimension gives at most t, or its best impact if that is less.
        """
        n = len(self.ids)
        dims = np.flatnonzero(q)
        if not len(dims) or np.abs(q).sum() * self.exact >= MET / 4:
            return others  # beyond what is summed without loss here, all are rescored
        weight = q[dims].astype(np.float64)
        first, last = self.values[dims, 0], self.values[dims, -1]
        best = np.where(weight > 0, last, first) * weight
        # a floor to begin with: the k-th best of the first vectors
        floor = float(np.partition(self.scores(others[: 16 * k], q), -k)[-k])
        both = np.zeros(n)  # the gains, and MET for each dimension met
        done = np.zeros(len(dims), np.int64)  # postings read of each dimension, from its best end
        for stop in [best.max() * share for share in STOPS] + [-np.inf]:
            if np.minimum(best, stop).sum() > floor:
                continue  # even a vector that has met nothing could still reach the floor here
            for m, (d, w) in enumerate(zip(dims.tolist(), weight.tolist(), strict=True)):
                if best[m] <= stop:
                    continue
                v = self.values[d]
                if w > 0:
                    upto = n - int(v.searchsorted(stop / w, "right"))
                    new = slice(n - upto, n - int(done[m]))
                else:
                    upto = int(v.searchsorted(stop / w, "left"))
                    new = slice(int(done[m]), upto)
                if upto > done[m]:
                    gain = v[new] * w
                    gain += MET
                    both[self.order[d, new]] += gain  # a vector stands once in a dimension's list
                    done[m] = upto
            met = np.floor(both / MET + 0.5)
            upper = both - met * MET
            if stop != -np.inf:
                open_dims = best > stop
                upper += (open_dims.sum() - met) * stop + best[~open_dims].sum()
            if len(others) < n:
                upper = upper[others]
            lead = others[np.argpartition(upper, len(others) - k)[len(others) - k :]]
            floor = max(floor, float(self.scores(lead, q).min()))
            possible = others[upper >= floor - 0.5]
            if len(possible) <= max(8 * k, n * RESCORE):  # to rescore them costs less than to process more
                break
        return possible


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, chunk: int = CHUNK, block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of vectors for every row of queries (both vec_id, embedding)."""
    spark = vectors.sparkSession
    prepare(spark)
    usable = (lambda df: df.selectExpr("cast(vec_id as long) vec_id", "embedding").filter("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"))
    vectors, queries = usable(vectors), usable(queries)
    dims = vectors.agg(F.max(F.size("embedding"))).first()[0]
    dims = max(1, dims or 0, queries.agg(F.max(F.size("embedding"))).first()[0] or 0)
    chunks, across = packs(vectors, chunk, dims, True)
    if block is None:
        wanted = -(-CELLS * spark.sparkContext.defaultParallelism // across)  # blocks that give every core some cells
        block = min(BLOCK, max(LEAST_BLOCK, -(-queries.count() // wanted)))
    asked, down = packs(queries, block, dims, False)
    # a grid: chunk c and block r meet in cell c * down + r; in a cell the chunk comes first
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    wide = chunks.select("*", every(down).alias("other")).selectExpr(f"number * {down} + other cell", "0 kind", "n", "ids", "data", "listed")
    tall = asked.select("*", every(across).alias("other")).selectExpr(f"other * {down} + number cell", "1 kind", "n", "ids", "data", "listed")
    tasks = min(TASKS, across * down)
    cells = wide.unionByName(tall).repartitionById(tasks, F.expr(f"cast(cell % {tasks} as int)")).sortWithinPartitions("cell", "kind")

    def run(batches):
        schema = arrow_schema(FOUND)
        here, index = None, None
        for batch in batches:
            for row in range(batch.num_rows):  # one pack at a time
                cell, kind, n, ids, data, listed = (c[row].as_py() for c in batch.columns)
                ids, data = np.frombuffer(ids, np.int64), np.frombuffer(data, np.int32).reshape(n, dims)
                if kind == 0:
                    here, index = cell, ImpactIndex(ids, data, np.frombuffer(listed, np.uint16 if n <= 1 << 16 else np.uint32).reshape(dims, n))
                elif here == cell:
                    for at in range(0, n, 512):
                        out_q, out_v, out_s = [], [], []
                        for query_id, q in zip(ids[at : at + 512].tolist(), data[at : at + 512].astype(np.int64), strict=True):
                            best, score = index.top(query_id, q, k)
                            out_q.append(np.full(len(best), query_id))
                            out_v.append(best)
                            out_s.append(score)
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_q, out_v, out_s)], schema=schema)

    found = cells.mapInArrow(run, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB: the same result in SQL.
SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS z FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, 1 + len(q.z)), lambda i: q.z[i] * c.z[i]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
