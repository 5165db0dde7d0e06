"""Connected components of a link table, by alternating large and small stars.

Each round joins and pre-aggregates links by node and writes them to the shared
checkpoint folder; the driver sees two numbers a round.  Links only get fewer, and the
rounds grow with the logarithm of the longest path, not with the path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evenkeel.stages import publish


def _directed(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    hubs = least.select("a", F.least("a", "least").alias("hub"))
    return both.join(hubs, "a").where("b > a").select(F.col("b").alias("a"), F.col("hub").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    hubs = links.groupBy("a").agg(F.min("b").alias("hub"))
    moved = links.join(hubs, "a").where("b <> hub").select(F.col("b").alias("a"), F.col("hub").alias("b"))
    return moved.unionAll(hubs.select("a", F.col("hub").alias("b")))


def _state(links: DataFrame) -> tuple:
    # decimals, so that the sum cannot overflow
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(links.agg(F.count(F.lit(1)), mark).first())


def connected_components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) for every node of a link (a, b); the root is the smallest node reachable.

    Direction, repeats and links of a node to itself don't matter.  No links: no rows.
    """
    links = publish(_directed(links), name)
    state = _state(links)
    while state[0]:
        links = publish(_directed(_small_star(_directed(_large_star(links)))), name)
        before, state = state, _state(links)
        if state == before:
            break
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
