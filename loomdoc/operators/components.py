"""Connected components of an edge table, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.session import file_count, written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def _pointed(edges: DataFrame, both: bool) -> DataFrame:
    """Edges a > b; each neighbour of a node is pointed at the least node of its neighbourhood.

    both: larger neighbours are pointed at it (large star); else the smaller ones and the node itself (small star).
    """
    if both:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        kept = edges.join(least, "a")
        moved = kept.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges (a long, b long): the least node that it is joined with. By alternating stars."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges", files=file_count(edges))
    before = None
    for _ in range(rounds):
        state = _state(now)
        if state == before or not state[0]:
            break
        before = state
        now = written(_pointed(_pointed(now, True), False), "edges", files=file_count(now))  # a round makes no more edges than it gets
    else:
        raise RuntimeError("components did not settle")
    pointed = now.groupBy("a").agg(F.min("b").alias("b"))
    nodes = pointed.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(nodes.select("component", "component").distinct())
