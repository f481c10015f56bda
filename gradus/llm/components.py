"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round points nodes at the smallest neighbour they know, with a pre-aggregated minimum by node, so a hub with a
third of all links costs no task its whole list. Rounds are written to the shared folder; nothing is collected but a
count. Each round leaves stars where a component is done, and the last one is told by there being nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _pointed(links: DataFrame, least: DataFrame) -> DataFrame:
    return links.join(least, "u")


def _large(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _pointed(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _pointed(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether links are stars: a node has one link down and is no other's end, or has none."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("down")).unionAll(links.select("v", F.lit(0)))
    open_ones = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("ends")).where("down > 0 AND ends > 1")
    return open_ones.agg(F.count("*")).first()[0] == 0


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of (u, v) links of longs; a component is named by its smallest node.

    Links may repeat, run either way or join a node to itself; nulls are left out. Nodes without another stay away.
    """
    links = stored(links.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    rounds = 0
    while not _settled(links):
        if rounds == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        links, rounds = stored(_small(stored(_large(links), "star")), "links"), rounds + 1
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
