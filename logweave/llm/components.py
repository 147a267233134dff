"""Connected components of a large link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logweave.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links (a, b)``; a component is named by its smallest node.

    Rounds of contraction: every node points to the smallest of itself and its neighbours, pointers
    are followed to their ends by doubling, and links are renamed to those ends; links within one end
    drop out. The number of rounds grows with the logarithm of the longest path; stars need two.
    Neighbours are reduced before they are shuffled, and each step is written, so neither a node
    with very many links nor a lost executor holds it up.
    """
    edges = _distinct(links.select("a", "b"))
    ends: DataFrame | None = None
    while True:
        edges = written(edges, "links")
        if edges.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")) if ends is None else ends
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        lowest = both.groupBy("node").agg(F.min("other").alias("other"))
        points = _followed(written(lowest.select("node", F.least("other", "node").alias("component")), "pointers"))
        if ends is None:
            ends = points
        else:
            further = points.select(F.col("node").alias("component"), F.col("component").alias("to"))
            ends = written(ends.join(further, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "ends")
        a = points.select(F.col("node").alias("a"), F.col("component").alias("x"))
        b = points.select(F.col("node").alias("b"), F.col("component").alias("y"))
        edges = _distinct(edges.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _followed(points: DataFrame) -> DataFrame:
    """Pointers replaced by the end of the way they begin; every pointer leads to a node of the table."""
    while True:
        onward = points.select(F.col("node").alias("component"), F.col("component").alias("to"))
        doubled = written(points.join(onward, "component").select("node", F.col("to").alias("component"), (F.col("to") != F.col("component")).alias("moved")), "pointers")
        points = doubled.select("node", "component")
        if doubled.where("moved").isEmpty():
            return points
