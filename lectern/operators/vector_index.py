"""Nearest vectors by centroid lists: stored lists of unit vectors, of which a search reads the few nearest to its query and ranks them exactly.

    path/centroids               no, centre, probes: learned from a bounded sample
    path/lists/batch=<n>/no=<c>  key, vector (of length 1)
    path/reach/batch=<n>         no, angle: how far a list's vectors lie from their centre

Batches count as in `plans.batches`, so the index follows writes. How many lists are read is measured when centroids are learned: as many as held RECALL of the true neighbours of
queries from the sample. The exact search goes on from there: a list whose best possible cosine, by its centre and its reach, is beneath the k-th best so far is left out, all others are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..plans import batches

#: Rows and bytes of the sample, rounds of learning, lists at most, and the recall by which the number of lists to read is chosen, for so many neighbours of so many queries.
SAMPLE, SAMPLE_BYTES, ROUNDS, LISTS, RECALL, NEIGHBOURS, QUERIES = 20_000, 64 << 20, 8, 512, 0.95, 10, 200


def unit_rows(rows: DataFrame, key: str) -> DataFrame:
    """key, vector: the usable vectors at length 1; null, zero and non-finite ones are gone."""
    usable = rows.select(F.col(key).alias("key"), "vector").filter("key IS NOT NULL AND size(vector) > 0 AND exists(vector, x -> x <> 0) AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return usable.withColumn("_length", length).select("key", F.transform("vector", lambda x: (x.cast("double") / F.col("_length"))).alias("vector"))


def learn(sample: np.ndarray, lists: int, seed: int = 1) -> tuple[np.ndarray, int]:
    """Centres of length 1 by spherical k-means, and the number of lists to read."""
    rng = np.random.default_rng(seed)
    centre = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(ROUNDS):
        near = (sample @ centre.T).argmax(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, sample)
        length = np.linalg.norm(sums, axis=1)
        lost = length < 1e-9
        sums[lost] = sample[rng.choice(len(sample), int(lost.sum()))]  # an empty list begins anew somewhere
        centre = sums / np.linalg.norm(sums, axis=1)[:, None]
    near = (sample @ centre.T).argmax(1)
    asked = rng.choice(len(sample), min(QUERIES, len(sample)), replace=False)
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -2
    best = np.argsort(-scores, axis=1)[:, : min(NEIGHBOURS, len(sample) - 1)]
    place = np.argsort(np.argsort(-(sample[asked] @ centre.T), axis=1), axis=1)  # by query and list: how many lists are nearer
    needed = np.sort(np.take_along_axis(place, near[best], axis=1).ravel()) + 1
    return centre, int(needed[int(np.ceil(RECALL * len(needed))) - 1]) if len(needed) else lists


class VectorIndex(NamedTuple):
    path: str
    key: str

    def create(self, rows: DataFrame, lists: int | None = None) -> None:
        """Learns the centroids from a sample of rows (key, vector) and writes all rows as batch 0. Vectors of the most frequent length in the sample are indexed."""
        units = unit_rows(rows, self.key)
        n = units.count()
        dims = [r.dims for r in units.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()]
        dims = dims[0] if dims else 1
        most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dims)))
        lists = max(1, min(lists or round(n**0.5), LISTS, n, most))

        def run(found):
            held = [np.array(b.column(0).to_pylist(), np.float64).reshape(b.num_rows, dims) for b in found]
            sample = np.concatenate(held) if held else np.zeros((0, dims))
            centre, probes = learn(sample, min(lists, len(sample))) if len(sample) else (np.eye(1, dims), 1)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(centre)), pa.int32()), pa.array(centre.tolist(), pa.list_(pa.float64())), pa.array([probes] * len(centre), pa.int32())], ["no", "centre", "probes"])

        sample = units.filter(F.size("vector") == dims).orderBy(F.xxhash64("key"), "key").limit(most)
        sample.select("vector").repartition(1).mapInArrow(run, "no int, centre array<double>, probes int").write.parquet(f"{self.path}/centroids")
        self.write(rows, 0)

    def centroids(self, spark: SparkSession) -> tuple[np.ndarray, int]:
        """At most LISTS rows."""
        rows = sorted(spark.read.parquet(f"{self.path}/centroids").collect())
        return np.array([r.centre for r in rows]), rows[0].probes

    def write(self, rows: DataFrame, batch: int, removed: DataFrame | None = None) -> None:
        """Writes rows (key, vector) as a batch, and takes out the keys of removed."""
        centre, _ = self.centroids(rows.sparkSession)
        kind = rows.schema[self.key].dataType.simpleString()

        def run(found):
            for b in found:
                m = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, centre.shape[1])
                product = m @ centre.T
                near = product.argmax(1)
                angle = np.arccos(np.clip(product[np.arange(len(m)), near], -1, 1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(angle)], ["key", "vector", "no", "angle"])

        units = unit_rows(rows, self.key).filter(F.size("vector") == centre.shape[1])
        dealt = units.mapInArrow(run, f"key {kind}, vector array<double>, no int, angle double")
        dealt.select(F.col("key").alias(self.key), "vector", "angle", "no").hint("rebalance", "no").write.mode("overwrite").partitionBy("no").parquet(f"{self.path}/lists/batch={batch}")
        stored = rows.sparkSession.read.schema(f"{self.key} {kind}, vector array<double>, angle double, no int").parquet(f"{self.path}/lists/batch={batch}")
        stored.groupBy("no").agg(F.max("angle").alias("angle")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/reach/batch={batch}")
        gone = rows.select(self.key) if removed is None else rows.select(self.key).unionByName(removed.select(self.key))
        batches.finish(gone, self.path, batch)

    def _best(self, spark: SparkSession, query: Sequence[float], k: int, lists: list[int]) -> DataFrame:
        found = batches.current(spark, self.path, "lists", self.key, "vector array<double>, angle double, no int", lambda rows: rows.filter(F.col("no").isin(lists)))
        scored = found.select(self.key, vectors.cosine(F.col("vector"), query).alias("similarity"))
        return scored.orderBy(F.desc("similarity"), self.key).limit(k)

    def search(self, spark: SparkSession, query: Sequence[float], k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
        """key, similarity: the k most similar vectors, best first, among the lists that are read; with exact among all. A zero query finds nothing."""
        centre, measured = self.centroids(spark)
        q = np.asarray(query, np.float64)
        if q.shape != centre.shape[1:] or not np.isfinite(q).all() or not q.any():
            return self._best(spark, [1.0] * centre.shape[1], k, [])
        cosine = centre @ (q / np.linalg.norm(q))
        order = np.argsort(-cosine, kind="stable")
        chosen = order[: probes or measured].tolist()
        found = self._best(spark, query, k, chosen)
        if not exact:
            return found
        first = found.collect()  # k rows
        floor = first[-1].similarity if len(first) == k else -1.0
        reach = np.full(len(centre), -1.0)
        for r in batches.read(spark, self.path, "reach", batches.done(spark, self.path)).groupBy("no").agg(F.max("angle").alias("angle")).collect():
            reach[r.no] = r.angle
        bound = np.cos(np.maximum(0, np.arccos(np.clip(cosine, -1, 1)) - reach - 1e-6))
        more = [c for c in order.tolist() if reach[c] >= 0 and bound[c] >= floor - 1e-6 and c not in set(chosen)]
        return self._best(spark, query, k, chosen + more) if more else found
