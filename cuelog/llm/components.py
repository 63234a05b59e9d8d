"""Connected components of links, without bringing links or nodes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link, from ``x`` and ``y`` (long): the smallest node that it reaches.

    Alternating star contraction: every node hands its larger neighbours, then its smaller
    ones, to its smallest neighbour, until all links lead to a smallest node.  A node's
    smallest neighbour is a minimum with map-side combine, so hubs gather nothing.  Each
    step is written to the shared folder; the driver sees one checksum a round.
    """
    def star(edges: DataFrame, larger: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))) if larger else edges
        least = both.groupBy("x").agg(F.min("y").alias("_m")).select("x", F.least("x", "_m").alias("_m"))
        joined = both.join(least, "x")
        moved = joined.filter(F.col("y") > F.col("x")).select(F.col("y").alias("x"), F.col("_m").alias("y")) if larger else joined.select(F.col("y").alias("x"), F.col("_m").alias("y"))
        kept = moved if larger else moved.unionByName(least.select("x", F.col("_m").alias("y")))
        return kept.filter(F.col("x") != F.col("y")).distinct()

    edges = cut_lineage(links.filter(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        edges = cut_lineage(star(star(edges, True), False))
    return edges.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(edges.select(F.col("y").alias("node"), F.col("y").alias("component"))).distinct()
