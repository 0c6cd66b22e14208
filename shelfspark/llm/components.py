"""Connected components by alternating stars (large-star, small-star) over a written edge table.

Every round halves the depth of the trees. Nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _least(links: DataFrame) -> DataFrame:
    """(u, m): the smallest neighbour of each node. Written, so that both sides of the join with it are plain
    shuffles: adaptive execution splits the links of a hub only then, not above an aggregate."""
    return staged(links.groupBy("u").agg(F.min("v").alias("m")), "least-neighbours")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    return (edges.join(_least(edges), "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .filter("u > v").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links between long ids -> (node, root): the smallest id reachable, for every linked node
    that is not a root itself. Self links and nulls are ignored; no links give no rows."""
    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .filter("u > v").distinct(), "links")
    state = _state(now)
    while state[0]:
        now = staged(_small_star(staged(_large_star(now), "large-stars")), "links")
        if (then := _state(now)) == state:
            break
        state = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
