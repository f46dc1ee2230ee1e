"""Connected components of links between documents, as DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.llm.common import stash


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component: the smallest node reachable. One row a node.

    Large-star and small-star steps in turn, each a minimum by node and a join back, until every component is a star:
    no node has two smaller ones, and none that has one is another's smaller one. Every step is written to the shared
    folder, so that a lost executor costs one step at most.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.join(least.hint("merge"), "u")
        if large:
            moved = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            moved = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.where("a != b")

    def stars(edges: DataFrame) -> bool:
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        wrong = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0")
        return wrong.isEmpty()

    edges = stash(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not stars(edges):
        edges = stash(star(star(edges, True), False).distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
