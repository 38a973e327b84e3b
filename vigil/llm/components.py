"""Connected components by alternating large-star and small-star rounds.

Every round is joins and grouped minima over the links, whose number only falls; each round
is stored, so nothing is recomputed after a lost executor. A hub with very many links is one
row on the aggregated side of the join, and the adaptive skew join splits the other side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import materialize


def _signature(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def _round(links: DataFrame) -> DataFrame:
    # large star: every larger neighbour of a node links to the least node around it
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    large = (
        both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    )
    # small star: a node and its smaller neighbours link to the least of them
    low = large.groupBy("a").agg(F.min("b").alias("low"))
    joined = large.join(low, "a")
    return (
        joined.select("a", F.col("low").alias("b"))
        .unionByName(joined.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")))
        .distinct()
    )


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the least node of the component."""
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    current = materialize(ordered, "links")
    seen = _signature(current)
    while seen[0]:
        current = materialize(_round(current), "links")
        now = _signature(current)
        if now == seen:
            break
        seen = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
