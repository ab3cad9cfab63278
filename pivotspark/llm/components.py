"""Connected components of a large edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over ``edges(u, v)`` with u > v.  Large: every larger
    neighbour of a node moves to its smallest neighbour (or itself).  Small:
    the smaller neighbours and the node itself do.  The minima are written, so
    that the join sees two plain tables and a hot node's rows can be split."""
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(sides.groupBy("u").agg(F.min("v").alias("m")), "star").select("u", F.least("u", "m").alias("m"))
        return sides.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    low = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "star")
    moved = edges.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has either one smaller neighbour and no larger one,
    or larger ones only: then the components are told."""
    sides = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    node = sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return node.where((F.col("up") > 1) | (F.col("up") + F.col("down") > 1) & (F.col("up") > 0)).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of bigints, in any direction, repeats allowed.  Returns
    (u, root) for every node that is not its component's smallest; root is the
    smallest node.  Each step is written to the shared checkpoint folder; the
    number of steps grows with the logarithm of the longest path."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = stored(edges.distinct(), "edges")
    while not _are_stars(edges):
        edges = stored(_star(edges, large=True).distinct(), "edges")
        edges = stored(_star(edges, large=False).distinct(), "edges")
    return edges.select("u", F.col("v").alias("root"))
