"""Candidate graphs from bucket keys, and all pairs of a component in bounded blocks.

Both similarity joins share this: rows that meet in a bucket are linked to the bucket's
smallest row only (never pairwise), components of those links are gathered, and a large
component is cut into blocks of which every two meet in one task. A task holds two blocks
at most, whatever the size of the component.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.components import components
from flowlab.llm.text import sorted_groups
from flowlab.session import materialise

#: Rows of a block.
BLOCK = 256


def candidate_components(buckets: DataFrame) -> DataFrame:
    """(node, component) of the nodes that share a bucket; ``buckets`` has columns key and node.

    The smallest node of each key is found with partial sums, and joined back by plain
    exchanges, so that a bucket with very many rows can be split. Keys met once go first.
    """
    heads = buckets.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("high"))
    heads = materialise(heads.where("v < high").select("key", "v"), "heads")
    edges = buckets.join(heads, "key").select(F.col("node").alias("u"), "v")
    return components(edges)


def in_blocks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each member once for every task that needs it: columns component, low, high, own are added.

    ``members`` has columns node and component. A task is (component, low, high), the two
    blocks it compares; ``own`` is the block of the row.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    sizes = materialise(sizes.where(F.col("size") > block), "sizes")
    dealt = members.join(sizes, "component", "left").withColumn("blocks", F.ceil(F.coalesce("size", F.lit(1)) / block).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("size")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("*", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).drop("blocks", "other")


def per_task(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """Run ``work`` on the rows of each (component, low, high)."""

    def run(batches):
        for group in sorted_groups(batches, ["component", "low", "high"]):
            yield work(group)

    keys = ["component", "low", "high"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def heads_of(n: int, pairs) -> list[int]:
    """Union-find over 0..n-1: the smallest index of each one's group."""
    up = list(range(n))

    def find(a: int) -> int:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]
