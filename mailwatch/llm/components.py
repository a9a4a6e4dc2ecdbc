"""Connected components as joins and aggregates, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import pinned

#: Up to this many edges (2 MB) a round is one task, to which the minima are broadcast; more are spread by shuffles.
_SMALL = 1 << 17


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def _gathered(edges: DataFrame, few: bool) -> DataFrame:
    return edges.coalesce(1) if few else edges


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node with an edge to another one; component is its smallest reachable node.

    Each round links the neighbours of every node to the smallest of them: first those larger than
    the node, then the others. Rounds grow with the logarithm of the longest path. Minima are
    combined before the shuffle, so a node with very many edges is only a skewed join key, which
    adaptive execution splits. Edges with a null end and loops are left out.
    """
    at = edges.select(F.greatest(left, right).alias("v"), F.least(left, right).alias("u"), F.col(left), F.col(right))
    at = pinned(
        at.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("v") != F.col("u"))).select("v", "u").distinct()
    )
    before = None
    while (now := _mark(at)) != before:
        before = now
        few = now[0] <= _SMALL
        both = _gathered(at.unionByName(at.select(F.col("u").alias("v"), F.col("v").alias("u"))), few)
        least = both.groupBy("v").agg(F.least("v", F.min("u")).alias("m"))
        large = both.where(F.col("u") > F.col("v")).join(F.broadcast(least) if few else least, "v")
        large = large.select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(F.broadcast(lowest) if few else lowest, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        small = small.where(F.col("v") != F.col("u")).unionByName(lowest.select("v", F.col("m").alias("u")))
        at = pinned(_gathered(small, few).distinct())
    roots = at.select(F.col("u").alias("node")).distinct()
    return at.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
