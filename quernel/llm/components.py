"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _sign(edges: DataFrame) -> tuple[int, int]:
    got = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return got["n"], int(got["s"] or 0)


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b long. A row (node, root) for every node but the roots; root is the least node of the component.

    Each step keeps at most as many edges as there were; minima are pre-aggregated, so a node with very many
    neighbours costs no single task, and the lineage is cut after every step.
    """
    now = C.cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _sign(now)
    while before[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["k"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every edge of large points from a node to a lesser one
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(low, large["a"] == low["k"]).select(F.col("b").alias("x"), "m").filter("x <> m").union(low.select("k", "m"))
        now = C.cut(small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())
        after = _sign(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
