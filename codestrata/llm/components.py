"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a few equi-joins and minima by key, written to the shared folder, so no edges or labels reach the
driver and lost executors cost one task each. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import discard, small, written


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 31))).first()
    return tuple(r)


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) to (node, label): label is the smallest node that it is connected with. Nodes without
    an edge to another node don't appear; repeated edges, edges of a node with itself and an empty table are fine, nulls
    are passed over. Minima by node are combined before the shuffle, so a hub costs no more than others; they go to
    every executor while they are few (`small`)."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(small(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        lower = large.join(small(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(lower.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(now, large)
        now = after
        sign = _signature(now)
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
