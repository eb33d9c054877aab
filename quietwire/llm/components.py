"""Connected components of an edge table by large-star and small-star steps (Kiveris et al. 2014), all of it in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwire.llm.tables import with_group, written


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) with ``m``, the smallest b of each a; a hub's edges are dealt out."""
    return with_group(edges, "a", "b", m=(F.min("b"), F.min))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Ties neighbours of each node to the smallest one around it: the larger neighbours, or the node and its smaller ones."""
    if large:
        around = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        return _with_least(around).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    return _with_least(edges).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a > b")  # here a > b


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: longs); the root is the smallest node of the connected component and is listed too.

    Each round is written to the shared folder; it stops when a round changes nothing, after a number of rounds that grows with the logarithm of the size.
    """
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = written(edges.where("a <> b").select(larger, smaller).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("sum")).first()
        if state == seen or not state.n:
            break
        seen = state
        edges = written(_star(_star(edges, True), False).distinct(), "edges")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
