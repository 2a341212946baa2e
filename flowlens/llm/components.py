"""Connected components of a graph given by edges, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a``, ``b``; both long); the component is its smallest node.

    Each round ties the neighbours of a node to the smallest of them, first the
    larger ones, then the smaller ones, until all edges are stars. Minima are merged
    before they move and joined back, so a node with very many neighbours is never
    gathered in one place. Self loops and repeated edges do no harm; no edges give
    an empty result. Nulls are ignored.
    """
    edges = stored(_down(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))), "edges")
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b"), F.col("b")).distinct()
            )
        before = mark
        edges = stored(_down(_small_star(_down(_large_star(edges)))), "edges")


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger end ``a`` to its smaller end ``b``."""
    return (
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node go to the smallest of its neighbours or itself."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")
    return both.filter(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    joined = edges.join(least, F.col("a") == F.col("u"))
    return joined.select("b", "m").toDF("a", "b").union(least.select(F.col("u"), F.col("m")))
