"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, skew_join, stored


def connected_components(links: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, component) for every node of links (a long, b long); component is the least node that can be reached.

    Alternates large-star and small-star steps: each hangs nodes on the least neighbour they know, so every component becomes
    a star around its least node in about log(diameter) rounds. A round is grouped minima (combined before the shuffle) and joins with
    them, in which nodes with very many links are not shuffled; each round is a table in the checkpoint folder that goes with the next one, and only three sums reach the driver.
    """
    edges, remove = stored(links.filter("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            break
        before = state
        both = edges.unionByName(edges.selectExpr("b a", "a b"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).selectExpr("a", "least(a, m) m", "n")
        large = skew_join(both.filter("b > a"), least, "a", "n", 2 * state[0], hot_rows).selectExpr("b a", "m b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        hung = skew_join(large, least, "a", "n", 2 * state[0], hot_rows)
        small = hung.filter("b <> m").selectExpr("b a", "m b").unionByName(least.selectExpr("a", "m b"))
        done = remove
        edges, remove = stored(small.distinct(), "links")
        done()
    return edges.selectExpr("a node", "b component").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
