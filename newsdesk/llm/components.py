"""Connected components by alternating large and small stars (Kiveris et al., 2014), on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.common import Scratch


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to its root at most, and no root has one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("root"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("root")))
    each = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("root").alias("root"))
    return each.where((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("root") > 0))).isEmpty()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of `links` (a, b); the component is its smallest node.

    Each round of two stars at least halves the depth of what is left, keeps at most one edge per node and root,
    and is written, so a lost executor costs one round.
    """
    a, b = F.col("a"), F.col("b")
    edges = scratch.write(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b)
        down = large.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b)
        new = scratch.write(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        scratch.drop(edges)
        edges = new
    return edges.select(a.alias("node"), b.alias("component")).unionByName(edges.select(b.alias("node"), b.alias("component")).distinct())


def joined_components(found: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """`found` (node, component) after further links: only their ends' components are worked on."""
    one = links.join(found.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
    ends = one.join(found.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    roots = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = components(roots, scratch).select(F.col("node").alias("component"), F.col("component").alias("root"))
    moved = scratch.write(moved, "moved")
    known = found.unionByName(moved.select(F.col("component").alias("node"), "component").join(found.select("node"), "node", "left_anti"))
    return known.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
