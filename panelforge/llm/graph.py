"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.store import checkpointed


#: Bytes up to which a round's table of minima is broadcast.
SMALL = 16 << 20


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for each node of ``links``; the component is its smallest node.

    Each round hangs every node's larger neighbours, then its smaller ones, onto the smallest
    neighbour; stars are all that is left after a number of rounds that grows with the logarithm of
    the longest chain; rounds go on until then. Groups are reduced by ``min`` and joined back, never collected, so a node with
    very many neighbours is an ordinary (splittable) join key. Null and self links are ignored; an
    empty table gives an empty result.
    """
    edges = checkpointed(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    while not _stars(edges, near := _near(edges.count())):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(near(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        own = least.where("m < u").select("u", F.col("m").alias("v"))
        large = checkpointed(large.unionAll(own).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near(low), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def _near(edges: int) -> Callable[[DataFrame], DataFrame]:
    """Broadcast a table with at most a row for each edge's ends, if that is small; else leave the join to a shuffle."""
    return F.broadcast if edges * 48 <= SMALL else lambda df: df


def _stars(edges: DataFrame, near: Callable[[DataFrame], DataFrame]) -> bool:
    """Whether each node hangs on one root, and no root on another node."""
    many = edges.groupBy("u").count().where("count > 1").select("u")
    chained = edges.select(F.col("v").alias("u")).join(near(edges.select("u")), "u", "left_semi")
    return many.unionAll(chained).agg(F.count("*")).first()[0] == 0
