"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftnet.session import checkpointed


def _summary(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("big", "small")), F.sum(F.xxhash64("big", "small") % 1_000_003)).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge to another one: component is the smallest node reachable.

    ``edges`` has long columns a and b. Each round links all larger neighbours of a node to its smallest one, then all smaller
    ones, until every component is a star around its smallest node; rounds grow with the logarithm of the longest path. Only
    minima per node are gathered, so a hub is summed before the shuffle and split in the join by the adaptive plan.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct()
    links = checkpointed(pairs)
    seen = _summary(links)
    while seen[0]:
        both = links.select(F.col("big").alias("u"), F.col("small").alias("v")).union(links.select("small", "big"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("big"), F.col("m").alias("small")).distinct()
        lowest = large.groupBy("big").agg(F.min("small").alias("m"))
        joined = large.join(lowest, "big")
        star = joined.select("big", F.col("m").alias("small")).union(joined.select(F.col("small"), "m")).where("big > small").distinct()
        links = checkpointed(star)
        now = _summary(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("big").alias("node"), F.col("small").alias("component"))
