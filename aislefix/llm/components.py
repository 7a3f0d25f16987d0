"""Connected components of a link table, by alternating stars.

Each round rewires every node to the smallest node known among its neighbours,
first for larger neighbours, then for smaller ones; the links become stars
around the smallest node of each component. A round is written to the shared
folder and read back, so that lineage stays short and lost executors cost one
round at most. Nodes with very many neighbours are met by a join that can be
split, never gathered into one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from aislefix.operators.spread import spread_join
from aislefix.sources.tables import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """``links`` (u > v). Every node's larger neighbours go to its smallest neighbour or itself."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    larger = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    moved = spread_join(larger, least, "u", "left").select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v"))
    return moved.distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` (u > v). Every node's smaller neighbours, and itself, go to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = spread_join(links, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for each node of ``links`` (columns a, b): root is the smallest node of its component.

    An empty table of links gives an empty result; loops and repeated links do not matter.
    """
    stars = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars = materialize(stars.distinct(), "links")
    before = None
    for _ in range(most_rounds):
        mark = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if mark == before or mark[0] == 0:
            break
        before = mark
        stars = materialize(_small_star(_large_star(stars)), "links")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
