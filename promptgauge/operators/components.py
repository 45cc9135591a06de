"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from promptgauge.session import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node at the smallest node near it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "lowest")
    return (
        both.join(lowest, "a")
        .filter((F.col("b") > F.col("a")) & (F.col("b") != F.col("low")))
        .select(F.col("low").alias("a"), "b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours at the smallest of them."""
    lowest = written(edges.groupBy("b").agg(F.min("a").alias("low")), "lowest")
    moved = edges.join(lowest, "b").filter("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(lowest.select(F.col("low").alias("a"), "b")).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``text_id, component`` for every node of ``edges(a, b)``; a component is named by its lowest id.

    The rounds grow with the logarithm of the component size, not its diameter. A node with very
    many neighbours is reduced to its minimum map-side; no neighbour list is ever collected. The minima
    are written, so that the join back is between plain shuffles and can be split at such a node.
    """
    current = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    current = written(current, "edges")
    mark = _fingerprint(current)
    while mark[0]:
        current = written(_small_star(written(_large_star(current), "edges")), "edges")
        last, mark = mark, _fingerprint(current)
        if mark == last:
            break
    leaves = current.select(F.col("b").alias("text_id"), F.col("a").alias("component"))
    roots = current.select(F.col("a").alias("text_id"), F.col("a").alias("component")).distinct()
    return leaves.unionByName(roots)
