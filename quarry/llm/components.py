"""Connected components of a link table, on Spark, without collecting links:
large-star and small-star rounds, each staged in the shared folder.

Nodes are longs. A large-star links every larger neighbour of a node to the
node's smallest neighbour, a small-star its smaller ones; both keep the
components and end with each node linked to the smallest of its component.
The rounds aggregate with ``min`` before they shuffle, so a node with many
links is no hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage


def _star(links: DataFrame, larger_side: bool) -> DataFrame:
    """One star round over links (u, v)."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not larger_side:
        both = both.filter(F.col("v") < F.col("u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(least, "u")
    if larger_side:
        moved = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")) \
            .unionByName(least.select("u", F.col("m").alias("v")))
    moved = moved.filter(F.col("u") != F.col("v"))
    return moved if larger_side else moved.distinct()      # a large-star's doubles end in the small-star


def _is_done(links: DataFrame) -> bool:
    """Every node is linked down once at most, and to one that is linked no further."""
    one = lambda c, down: links.select(F.col(c).alias("node"), F.lit(down).alias("down"), F.lit(1 - down).alias("up"))
    nodes = one("u", 1).unionByName(one("v", 0)).groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not nodes.agg(F.count_if((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)))).first()[0]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v): the smallest node reachable."""
    links = stage(links.filter(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(most_rounds):
        if _is_done(links):
            break
        links = stage(_star(_star(links, True), False), "links")
    else:
        raise RuntimeError("components did not converge")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
