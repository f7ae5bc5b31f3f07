"""Hard negatives by branch and bound over ball trees.

Rows lie in chunks, and a chunk holds a tree of balls for each of its labels: a node has a centre and a radius, so the inner product of an anchor a with any of
its rows lies within |a| times the radius of the anchor's product with the centre, above and below. An anchor's positives are its best rows of its own label, found in the trees of
that label; its negatives are the best rows of the other labels whose score lies in a window that the positive's score sets. A search first goes
down to the most promising leaf, whose rows give it a k-th best to begin with, then level by level from the roots, and leaves out every node all of whose scores are outside
the windows or strictly beneath their k-th best so far. The leaves that remain are read from the most promising on, in growing portions, and each portion raises the k-th best.

Anchors come in blocks; blocks and chunks meet in a grid of cells that are dealt evenly by number (a stated query set against all rows, in blocks), so neither a label nor a
group of copies gathers in a task. Of each cell k rows a window leave the task. Trees are built once, and chunks written with them. There are two rounds, since windows
need the positives of all chunks; the positives of a block, of which there are at most `positives` for each anchor of the block, travel with it.

Results: components become floor(scale * x). Rows whose vec_id, label or vector is null, or that hold a null, NaN or infinite component, take no part. Shorter vectors
count as padded with zeros. Rows with the anchor's id are neither its positives nor its negatives. Anchors with equal ids are answered each for itself, and repeated rows are
found each for itself; ties go to the smaller vec_id, then arbitrarily among rows with the same id. A positive without negatives gives no row. Components that 32 bits do not hold, and scores that 64 bits do not hold,
are clamped to the range; where doubles may lose digits, all rows of a chunk are compared exactly. Other columns are not looked at. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_schema, checkpointed, prepare

#: Rows in a chunk and anchors in a block, at most about so many: what one task holds.
CHUNK, BLOCK = 16384, 16384

#: Anchors in a block at least, and cells for each core that are wanted before blocks grow.
LEAST_BLOCK, CELLS = 64, 3

#: Tasks over which cells are dealt at most, and rows in a leaf at most.
TASKS, LEAF = 20_000, 64

#: Pairs of an anchor and a node that are looked at together.
PAIRS = 20_000

PACK = "number long, n int, ids binary, labels binary, data binary, nodes binary, balls binary"


class BallTrees:
    """The rows of a chunk in the order of its trees' leaves, a tree for each label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, data: np.ndarray, nodes: np.ndarray | None = None, balls: np.ndarray | None = None):
        """nodes: start and end of a node's rows, its first child (the second follows; -1: leaf) and 1 for a root; balls: centre and radius."""
        self.ids, self.labels, self.data, self.nodes, self.balls = ids, labels, data, nodes, balls
        if nodes is None:
            self._grow()
        self.reals = self.data.astype(np.float64)
        self.start, self.end, self.child, root = self.nodes.T
        self.roots = np.flatnonzero(root)
        self.label = self.labels[self.start] if len(self.nodes) else np.empty(0, np.int64)
        self.centre, self.radius = np.ascontiguousarray(self.balls[:, :-1]), self.balls[:, -1]
        self.far = self.radius + np.sqrt((self.centre**2).sum(1))  # length of the longest row
        self.exact = float(np.abs(self.reals).max(initial=0))

    def _grow(self) -> None:
        x = self.data.astype(np.float64)
        order = np.argsort(self.labels, kind="stable")
        cuts = np.flatnonzero(np.diff(self.labels[order], prepend=self.labels[order[:1]] - 1)) if len(order) else np.empty(0, np.int64)
        nodes = [[s, e, -1, 1] for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=False)]
        balls, at = [], 0
        while at < len(nodes):
            s, e = nodes[at][:2]
            rows = x[order[s:e]]
            centre = rows.mean(0)
            away = ((rows - centre) ** 2).sum(1)
            balls.append([*centre, float(np.sqrt(away.max()))])
            if e - s > LEAF:  # what is nearer to one far row, and what is nearer to another; an eighth at least
                one = rows[away.argmax()]
                apart = ((rows - one) ** 2).sum(1)
                other = rows[apart.argmax()]
                nearer = apart - ((rows - other) ** 2).sum(1)
                middle = min(max(int((nearer < 0).sum()), (e - s) // 8), (e - s) - (e - s) // 8)
                order[s:e] = order[s:e][np.argpartition(nearer, middle)]
                nodes[at][2] = len(nodes)
                nodes += [[s, s + middle, -1, 0], [s + middle, e, -1, 0]]
            at += 1
        self.ids, self.labels, self.data = self.ids[order], self.labels[order], self.data[order]
        self.nodes = np.array(nodes, np.int64).reshape(-1, 4)
        self.balls = np.array(balls, np.float64).reshape(len(nodes), -1) if nodes else np.empty((0, x.shape[1] + 1))

    def scores(self, rows, q: np.ndarray) -> np.ndarray:
        """Exact scores of rows, clamped to 64 bits."""
        most = self.exact * float(np.abs(q).max(initial=0)) * max(1, len(q))
        if most < 2**52:
            return (self.reals[rows] @ q.astype(np.float64)).astype(np.int64)
        whole = self.data[rows].astype(object) @ q.astype(object)
        return np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in whole], np.int64)

    def search(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """For each anchor and each of its windows [low, high] (anchors x windows) the ids and scores of the k best rows of the anchor's label, or of the others."""
        found = []
        step = max(1, PAIRS // max(1, len(self.roots)))
        for at in range(0, len(ids), step):
            part = slice(at, at + step)
            one = Found(self, ids[part], labels[part], q[part], low[part], high[part], k, same)
            one.run()
            found += one.best
        return found


class Found:
    """The search of a chunk for some anchors."""

    def __init__(self, trees, ids, labels, q, low, high, k, same):
        self.t, self.ids, self.labels, self.q, self.low, self.high, self.k, self.same = trees, ids, labels, q, low, high, k, same
        self.reals = q.astype(np.float64)
        self.length = np.sqrt((self.reals**2).sum(1))
        self.kth = np.full(low.shape, -(2**63), np.int64)  # the k-th best score so far
        none = np.empty(0, np.int64)
        self.best = [[(none, none) for _ in range(low.shape[1])] for _ in ids]
        self.read = 0  # rows that were scored

    def bounds(self, a: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most and the least that a row of the node can score, widened by more than doubles lose."""
        mid = np.einsum("ij,ij->i", self.t.centre[node], self.reals[a])
        reach = self.length[a] * self.t.radius[node] + 1e-9 * self.length[a] * self.t.far[node] + 1e-6
        return mid + reach, mid - reach

    def open(self, a: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
        """By pair and window: may a score of the node be in the window and among the k best?"""
        return (most[:, None] >= np.maximum(self.low[a], self.kth[a])) & (least[:, None] <= self.high[a])

    def look(self, a: int, rows) -> None:
        """Scores rows and keeps the best of each window."""
        score, ids = self.t.scores(rows, self.q[a]), self.t.ids[rows]
        self.read += len(ids)
        other = ids != self.ids[a]
        for w in range(self.low.shape[1]):
            here = np.flatnonzero((score >= max(self.low[a, w], self.kth[a, w])) & (score <= self.high[a, w]) & other)
            if len(here):
                had = self.best[a][w]
                i, s = np.append(had[0], ids[here]), np.append(had[1], score[here])
                first = np.lexsort((i, -s))[: self.k]
                self.best[a][w] = i[first], s[first]
                if len(first) == self.k:
                    self.kth[a, w] = s[first[-1]]

    def run(self) -> None:
        t = self.t
        a, r = np.nonzero((t.label[t.roots][None, :] == self.labels[:, None]) == self.same)
        node = t.roots[r]
        most_q = np.abs(self.reals).max(1, initial=0) * t.exact * max(1, self.reals.shape[1])
        for lossy in np.flatnonzero(most_q >= 2**52).tolist():  # beyond doubles: every row
            self.look(lossy, np.concatenate([np.arange(t.start[n], t.end[n]) for n in node[a == lossy]] or [np.empty(0, np.int64)]))
        keep = most_q[a] < 2**52
        a, node = a[keep], node[keep]
        if not len(a):
            return
        # one way down for each anchor, to the most promising leaf
        most, least = self.bounds(a, node)
        first = np.lexsort((-most, a))
        first = first[np.diff(a[first], prepend=-1) > 0]
        who, at = a[first], node[first]
        while (inner := t.child[at] >= 0).any():
            left = np.where(inner, t.child[at], at)
            right = left + inner
            at = np.where(self.bounds(who, left)[0] >= self.bounds(who, right)[0], left, right)
        dived = np.full(len(self.ids), -1)
        dived[who] = at
        for j, n in zip(who.tolist(), at.tolist(), strict=True):
            self.look(j, slice(t.start[n], t.end[n]))
        # then every node that windows and k-th best leave open, level by level
        leaves = []
        while len(a):
            most, least = self.bounds(a, node)
            keep = self.open(a, most, least).any(1)
            a, node, most, least = a[keep], node[keep], most[keep], least[keep]
            leaf = t.child[node] < 0
            new = leaf & (node != dived[a])
            leaves.append((a[new], node[new], most[new], least[new]))
            a, node = np.repeat(a[~leaf], 2), (t.child[node[~leaf]][:, None] + np.arange(2)).ravel()
        a, node, most, least = (np.concatenate(x) for x in zip(*leaves, strict=True))
        # leaves of an anchor from the most promising on, by what they may give in a window
        order = np.lexsort((-np.minimum(most, self.high[a].max(1, initial=-(2**63))), a))
        cuts = np.flatnonzero(np.diff(a[order], prepend=-1, append=len(self.ids)))
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            mine, portion = order[s:e], 1
            j = int(a[mine[0]])
            while len(mine):
                now, mine = mine[:portion], mine[portion:]
                self.look(j, np.concatenate([np.arange(t.start[n], t.end[n]) for n in node[now].tolist()]))
                mine = mine[self.open(a[mine], most[mine], least[mine]).any(1)]
                portion = min(32, 2 * portion)


def packs(vectors: DataFrame, rows: int, dims: int, scale: float, grown: bool) -> tuple[DataFrame, int]:
    """Rows in numbered packs of about so many, dealt in turn, and how many numbers there are; grown packs carry their trees."""
    parts = -(-vectors.count() // rows) or 1

    def run(batches):
        from pyspark import TaskContext

        ids, labels, held = [], [], []
        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            labels.append(batch.column(1).to_numpy())
            out = np.zeros((batch.num_rows, dims), np.int32)
            for row, v in zip(out, batch.column(2).to_pylist(), strict=True):
                row[: len(v)] = np.clip(np.floor(scale * np.asarray(v, np.float64)), -(2**31), 2**31 - 1)
            held.append(out)
        if ids:
            ids, labels, data = np.concatenate(ids).astype(np.int64), np.concatenate(labels).astype(np.int64), np.concatenate(held)
            nodes = balls = b""
            if grown:
                trees = BallTrees(ids, labels, data)
                ids, labels, data, nodes, balls = trees.ids, trees.labels, trees.data, trees.nodes.tobytes(), trees.balls.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([len(data)], pa.int32()), *(pa.array([x]) for x in (ids.tobytes(), labels.tobytes(), data.tobytes(), nodes, balls))], schema=arrow_schema(PACK))

    return checkpointed(vectors.repartition(parts).mapInArrow(run, PACK)), parts


FOUND = "anchor_no long, anchor_id long, nth int, positive_id long, positive_score long, vec_id long, score long"


def met(chunks: DataFrame, across: int, asked: DataFrame, down: int, dims: int, k: int, window: tuple[int, int] | None) -> DataFrame:
    """FOUND for every cell of chunks and blocks. Without a window the anchors' own labels are searched; with one, in percents of a positive's score, the others, and blocks
    have a column places, (row, nth, vec_id, score) of their anchors' positives."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    place = "array<struct<row:int,nth:int,vec_id:bigint,score:bigint>>"
    names = ["n", "ids", "labels", "data", "nodes", "balls"]
    wide = chunks.select("*", every(down).alias("other")).selectExpr(f"number * {down} + other cell", "0 kind", "number", *names, f"cast(null as {place}) places")
    tall = asked.select("*", every(across).alias("other")).selectExpr(f"other * {down} + number cell", "1 kind", "number", *names, "places" if window else f"cast(null as {place}) places")
    tasks = min(TASKS, across * down)
    cells = wide.unionByName(tall).repartitionById(tasks, F.expr(f"cast(cell % {tasks} as int)")).sortWithinPartitions("cell", "kind")

    def run(batches):
        schema = arrow_schema(FOUND)
        here, trees = None, None
        for batch in batches:
            for row in range(batch.num_rows):  # one pack at a time
                cell, kind, number, n, ids, labels, data, nodes, balls = (c[row].as_py() for c in batch.columns[:9])
                ids, labels, data = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(data, np.int32).reshape(n, dims).astype(np.int64)
                if kind == 0:
                    here, trees = cell, BallTrees(ids, labels, data, np.frombuffer(nodes, np.int64).reshape(-1, 4), np.frombuffer(balls, np.float64).reshape(-1, dims + 1))
                elif here == cell:
                    if window is None:
                        of, held = np.arange(n), [[(0, None, None)] for _ in range(n)]
                    else:
                        by: dict[int, list] = {}
                        for p in batch.column(9)[row].as_py() or []:
                            by.setdefault(p["row"], []).append((p["nth"], p["vec_id"], p["score"]))
                        of = np.array(sorted(by), np.int64)
                        held = [by[r] for r in of.tolist()]
                    many = max(map(len, held), default=1)
                    low, high = np.full((len(of), many), 1, np.int64), np.zeros((len(of), many), np.int64)
                    for j, ps in enumerate(held):  # in whole numbers, which do not overflow
                        for w, (_, _, s) in enumerate(ps):
                            low[j, w], high[j, w] = (-(2**63), 2**63 - 1) if window is None else (-(-window[0] * s // 100), window[1] * s // 100)
                    best = trees.search(ids[of], labels[of], data[of], low, high, k, window is None)
                    out = [[] for _ in FOUND.split(",")]
                    for r, ps, windows in zip(of.tolist(), held, best, strict=True):
                        for (nth, p_id, p_score), (found, score) in zip(ps, windows, strict=False):
                            for column, x in zip(out, ((number << 32) + r, int(ids[r]), nth, p_id, p_score), strict=False):
                                column += [x] * len(found)
                            out[5] += found.tolist()
                            out[6] += score.tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return cells.mapInArrow(run, FOUND)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: float = 256.0, chunk: int = CHUNK, block: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of anchors against those of vectors (both vec_id, embedding, label).

    window is in percents of the positive's score, both ends included.
    """
    spark = vectors.sparkSession
    prepare(spark)
    usable = lambda df: df.selectExpr("cast(vec_id as long) vec_id", "cast(label as long) label", "embedding").filter("vec_id is not null and label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    vectors, anchors = usable(vectors), usable(anchors)
    dims = max([1, *(df.agg(F.max(F.size("embedding"))).first()[0] or 0 for df in (vectors, anchors))])
    chunks, across = packs(vectors, chunk, dims, scale, True)
    if block is None:
        wanted = -(-CELLS * spark.sparkContext.defaultParallelism // across)  # blocks that give every core some cells
        block = min(BLOCK, max(LEAST_BLOCK, -(-anchors.count() // wanted)))
    asked, down = packs(anchors, block, dims, scale, False)
    ranked = lambda df, keys, k: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    best = ranked(met(chunks, across, asked, down, dims, positives, None), ["anchor_no"], positives)
    places = best.groupBy(F.shiftright("anchor_no", 32).alias("number")).agg(F.collect_list(F.struct(F.expr("cast(anchor_no & 4294967295 as int) row"), F.col("rank").alias("nth"), "vec_id", "score")).alias("places"))
    hard = met(chunks, across, asked.join(checkpointed(places), "number"), down, dims, negatives, window)
    found = ranked(hard, ["anchor_no", "nth"], negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: DuckDB: the same result in SQL.
SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row_no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS z FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.row_no, a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, list_sum(list_transform(range(1, 1 + len(a.z)), lambda i: a.z[i] * o.z[i]))::BIGINT AS score
  FROM v a JOIN v o ON o.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS nth FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.row_no, p.nth ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.row_no = p.row_no AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.nth <= 5
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
