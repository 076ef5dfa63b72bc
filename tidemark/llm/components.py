"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        both.where(F.col("v") > F.col("u"))
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node's smaller neighbours, and itself, on the smallest of them (here v < u)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    hung = joined.where(F.col("v") != F.col("m")).select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    own = least.select("u", F.col("m").alias("v"))
    return hung.unionByName(own).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        ).first()
    )


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has a link.

    Every round is two aggregates and two joins over tables of at most one row per link, written
    to the shared folder; a node with very many links is met by partial aggregates and by joins
    that can be split. The number of rounds grows with the logarithm of the longest path.
    """
    edges = written(
        links.select(
            F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")
        )
        .where(F.col("u") != F.col("v"))
        .distinct()
    )
    mark = _mark(edges)
    while mark[0]:
        edges = written(_small_star(_large_star(edges)))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
