"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.session import materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; ``component`` is the smallest node reachable.

    ``edges`` has columns u and v, both without nulls; loops and repeated edges do not
    matter. Every round is written to the shared folder, so lost executors cost one round
    at most, and every join has plain exchanges on both sides, so that adaptive execution
    splits a centre with very many neighbours. No nodes or edges ever reach the driver,
    only a count and a checksum per round. No edges: no rows.
    """
    now = materialise(edges.where("u <> v").select("u", "v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        ways = _both_ways(now)
        least = materialise(ways.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Every node now points at a smaller one only; the second star links those ends.
        large = materialise(large.distinct(), "large")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        links = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        after = materialise(links.where("u <> v").distinct(), "edges")
        was, state, now = state, _state(after), after
        if was == state:
            break
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads).distinct()
