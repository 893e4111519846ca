"""Connected components of a graph given as edges, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, settled, spread_join


def _around(rows: DataFrame, few: bool) -> DataFrame:
    """rows (u, v) with m, the least v of each u. A centre may have any share of the rows: those of large ones are never gathered."""
    stars = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    if few:
        return rows.join(F.broadcast(stars.drop("n")), "u")
    return spread_join(rows, settled(stars), ["u"], "n")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Links each neighbour that is larger than u to the least node around u."""
    return _around(_both_ways(edges), few).where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.least("u", "m").alias("b"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """Links u and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    moved = _around(down, few)
    return moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(moved.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of long: node, component (the least node that can be reached), for all nodes with an edge to another.

    Ends as every component is a star around its least node; the number of rounds grows with the logarithm of
    the longest path.
    """
    edges = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = _sign(edges)
    while sign[0]:
        few = sign[0] <= BROADCAST_ROWS // 2  # edges count both ways
        larger = _large_star(edges, few)
        edges = settled(_small_star(larger if few else settled(larger), few).where("a <> b").distinct())
        before, sign = sign, _sign(edges)
        if before == sign:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b"), F.col("b")).distinct())
