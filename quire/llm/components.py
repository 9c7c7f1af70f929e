"""Connected components of a table of links by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _both(links: DataFrame) -> DataFrame:
    return links.union(links.select("v", "u"))


def nodes(links: DataFrame) -> DataFrame:
    """Per node ``u``: the least of its neighbours and itself (``m``), and whether it lies in a star.

    A node does if it is a centre, with larger neighbours only, or a leaf, with one neighbour, a smaller one.
    """
    seen = _both(links).groupBy("u").agg(F.min("v").alias("a"), F.count("*").alias("n"))
    return seen.select("u", F.least("u", "a").alias("m"), ((F.col("a") > F.col("u")) | (F.col("n") == 1)).alias("star"))


def large_star(links: DataFrame, least: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of its neighbours and itself; links may repeat."""
    return _both(links).where("v > u").join(least.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them; links lead from large to small."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    others = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, rounds: int = 60, ordered: bool = False) -> DataFrame:
    """``u, v``: every node of ``links`` (columns ``u, v``) but the smallest of its component, and that smallest.

    Links from a node to itself and repeated links are passed over; links with a null end too.  With
    ``ordered`` the caller vouches that links are stored, distinct and lead from large to small.  The
    links are done when every node lies in a star, which the count of neighbours tells that a round
    begins with.
    """
    now = links if ordered else written(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(rounds):
        least = written(nodes(now), "star")
        if least.where("NOT star").isEmpty():
            return now
        now = written(small_star(large_star(now, least)), "links")
    raise RuntimeError(f"no fixed point after {rounds} rounds")
