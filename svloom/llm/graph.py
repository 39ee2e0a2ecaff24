"""Connected components of a distributed edge list by alternating star contractions.

No step gathers a group: each is a grouped minimum, which is pre-aggregated
before its shuffle, and an equi-join whose large side Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rounds after which the contraction is given up as a fault; it halves at least in each.
MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of an edge, root the smallest node that it reaches.

    Nulls and loops are no edges; repeated edges and both directions are the same edge.
    """
    now = (
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    now = written(now, "edges")
    before = _state(now)
    for _ in range(MOST_ROUNDS):
        # large star: every larger neighbour goes to the smallest of the closed neighbourhood
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        now = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        )
        # small star: a node and its smaller neighbours go to the smallest of these
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        near = now.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        now = written(near.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _state(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = after
    raise RuntimeError("the components did not settle")
