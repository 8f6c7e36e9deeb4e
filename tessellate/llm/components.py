"""Connected components of a distributed edge table (alternating large-star and
small-star rounds), with aggregates and bounded joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_on_hot_key, materialise

#: An edge table of at most this many rows is worked on in one partition, without
#: a shuffle and with one file a round; a larger one is spread.
ONE_TASK_EDGES = 200_000


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a, b``, bigint);
    root is the smallest node reachable.  Rounds end when the edge table stays
    the same; their number grows with the logarithm of the longest path.
    Each round's table is written to the shared folder.  Empty edges give an
    empty table; loops and repeated edges do no harm."""
    e = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    mark = _mark(e)
    while mark[0]:
        few = mark[0] <= ONE_TASK_EDGES
        e = materialise(_round(e, mark[0], few), "cc-edges")
        now = _mark(e.coalesce(1) if few else e)
        if now == mark:
            break
        mark = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _round(e: DataFrame, n: int, few: bool) -> DataFrame:
    """The edges after a large-star and a small-star step over ``n`` edges."""
    if few:
        return _small_round(e)
    both = materialise(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc-both")
    # large star: greater neighbours of a node go to the least of its neighbourhood
    least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("w")), "cc-least")
    large = materialise(join_on_hot_key(both.filter("b > a"), least, "a", "w", 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "cc-large")
    # small star: a node and its lesser neighbours go to the least of them
    least = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("w")), "cc-least")
    small = join_on_hot_key(large, least, "a", "w", n).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _small_round(e: DataFrame) -> DataFrame:
    """The same two steps over few edges, in one partition.  No side goes through
    the driver as a broadcast, and nothing is written or computed twice, so the
    plan, which the driver holds, stays small."""
    pairs = lambda d, *two: d.select(F.inline(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in two])))
    both = pairs(e.coalesce(1), ("a", "b"), ("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return pairs(small, ("b", "m"), ("a", "m")).filter("a <> b").distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
