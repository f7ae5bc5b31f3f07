"""Exact global row numbers without a single-partition window, and reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Quantiles of the scores and of the keys that bound cells, the same number whatever the data, and the accuracy of their sketch.
SCORES, KEYS, ACCURACY = 256, 64, 4096

#: Rows that are few enough for one cell, so that no sketch is needed.
FEW = 50_000


def bucketed(df: DataFrame, column: str, marks: list[float], name: str) -> DataFrame:
    """df with name: how many of the ascending marks are at most the column, by binary search."""
    if not marks:
        return df.withColumn(name, F.lit(0))
    from pyspark.ml.feature import Bucketizer

    out = Bucketizer(splits=[float("-inf"), *marks, float("inf")], inputCol=column, outputCol=name).transform(df)
    return out.withColumn(name, F.coalesce(F.col(name).cast("int"), F.lit(0)))  # never null, so that no join filters one branch alone


def global_row_number(df: DataFrame, score: str, key: str, name: str, scores: int = SCORES, keys: int = KEYS, few: int = FEW) -> DataFrame:
    """df with name: the row number by score descending, then key ascending, over all rows. Scores and keys are not null.

    Rows fall into ordered cells; a row's number is the rows in better cells plus its place in its own. Cells are bounded by quantiles of a sketch, one pass over df that
    leaves a fixed number of values: a score between two quantiles is in the cell of that gap, a score that is itself a quantile, as one that very many
    rows share, is in a cell of its own, which is cut again by quantiles of the key. So there are at most (2 * scores + 1) * (keys + 1) cells, none of which grows beyond its share of the rows,
    and the window over their counts is as small. Up to `few` rows, counted first, are one cell. There is one exchange, of df's columns, which counts and places share. Cells are functions of the row
    alone, so a recomputed task finds the same ones. Up to `few` rows are one cell. df is read twice: it should be a table.
    """
    share = lambda n: [k / n for k in range(n + 1)]
    marks, cuts = [], []
    if df.count() > few:
        row = df.agg(F.percentile_approx(score, share(scores), ACCURACY).alias("s"), F.percentile_approx(key, share(keys), ACCURACY).alias("k")).first()
        marks, cuts = sorted(set(row.s)), sorted(set(row.k))
    placed = bucketed(bucketed(df, score, marks, "_level"), key, [float(x) for x in cuts], "_part")
    is_mark = F.coalesce(F.element_at(F.array(*map(F.lit, marks)), F.nullif(F.col("_level"), F.lit(0))) == F.col(score), F.lit(False)) if marks else F.lit(False)
    placed = placed.withColumn("_part", F.when(is_mark, F.col("_part")).otherwise(0)).withColumn("_level", is_mark.cast("int") - 2 * F.col("_level"))
    cells = ["_level", "_part"]
    placed = placed.repartition(*cells)
    before = Window.orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
    # counts every row; the hash holds on to all columns, as only equal exchanges are shared
    every = F.count(F.when(F.xxhash64(*df.columns) >= F.lit(-(1 << 63)), 1))
    offsets = placed.groupBy(*cells).agg(every.alias("_n")).select(*cells, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*cells).orderBy(F.desc(score), F.asc(key)))
    return placed.withColumn("_in", inside).join(F.broadcast(offsets), cells).select(*df.columns, (F.col("_before") + F.col("_in")).cast("long").alias(name))


def ranks_by_counting(df: DataFrame, score: str, key: str, points: list[tuple]) -> dict:
    """The row number of each row of points, (score, key), in df ordered by score descending, then key ascending, by key. The points are few.

    Each row finds its place among the points' scores by binary search, and among the keys of one score only where it has that very score; what is counted is the rows
    of each place. So each task sends three rows a point at most, and df is neither sorted nor exchanged.
    """
    if not points:
        return {}
    marks = sorted({s for s, _ in points})
    keys = [sorted(k for s, k in points if s == mark) for mark in marks]
    placed = bucketed(df, score, marks, "_level")
    at = F.nullif(F.col("_level"), F.lit(0))
    level_keys = F.element_at(F.array(*(F.array(*map(F.lit, own)) for own in keys)), at)
    tied = F.when(F.element_at(F.array(*map(F.lit, marks)), at) == F.col(score), F.size(F.filter(level_keys, lambda x: x <= F.col(key))))
    counts = placed.groupBy("_level", tied.alias("_tied")).count().collect()
    out = {}
    for level, own in enumerate(keys, 1):
        for no, k in enumerate(own):  # a row of this score is ahead of k if no more than k's predecessors are at or before it
            out[k] = 1 + sum(r["count"] for r in counts if r._level > level or r._level == level and (r._tied is None or r._tied <= no))
    return out


def best(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The n best rows by score descending, then key ascending: each task keeps n."""
    return df.orderBy(F.desc(score), F.asc(key)).limit(n)


def deepest(floor: float, k: int) -> int:
    """The last rank in the better of two lists that can still reach a floor of the fused score: both ranks would have to be it."""
    return max(0, int(2 / floor - k + 1e-9))


def reciprocal(rank: Column, k: int) -> Column:
    """1 / (k + rank) in doubles, 0 for a row that a list lacks; a literal 1.0 in SQL would be a decimal."""
    return F.coalesce(F.lit(1.0) / (F.lit(float(k)) + rank), F.lit(0.0))


def fused(semantic_rank: Column, text_rank: Column, k: int) -> Column:
    return reciprocal(semantic_rank, k) + reciprocal(text_rank, k)
