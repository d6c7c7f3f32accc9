"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.session import materialize


def _stars(links: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none, or none."""
    ends = links.select(F.col("hi").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(links.select("lo", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b; any order): root is the smallest node reachable.

    Each round hangs a node's larger neighbours, then its smaller ones, on the smallest (map-side
    minima; a hot node's links are split by the skew join) and is written out; rounds end when the
    links are stars, each around its smallest node, after about log² of the longest chain.
    """
    ends = lambda a, b: (F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    links = materialize(links.where("a <> b").select(*ends("a", "b")).distinct())
    while not _stars(links):
        both = links.union(links.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(*ends("v", "m")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        small = small.select("hi", "m").union(small.select("lo", "m")).toDF("a", "b").where("a <> b")
        links = materialize(small.select(*ends("a", "b")).distinct())
    roots = links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(links.select("lo", "lo").distinct())
