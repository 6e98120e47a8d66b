"""Structural similarity of entities (R2a, R2b) as a sparse self-join on shared neighbours: absent pairs are 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEASURES = ("js", "jaccard", "uem", "scm")  # js and jaccard are one


def _met(links: DataFrame) -> DataFrame:
    """links (x, y) distinct: (a, b, na, nb) of a < b, once for each common y. The sizes come with the links, so pairs, which are many
    more than links, are not joined with anything."""
    of = links.join(links.groupBy("x").agg(F.count("*").alias("n")), "x")
    return of.alias("l").join(of.alias("r"), (F.col("l.y") == F.col("r.y")) & (F.col("l.x") < F.col("r.x"))).select(F.col("l.x").alias("a"), F.col("r.x").alias("b"), F.col("l.n").alias("na"), F.col("r.n").alias("nb"))


def similar_pairs(edges: DataFrame, measure: str = "uem") -> DataFrame:
    """(a, b, similarity) of pairs a < b that share a neighbour. jaccard and uem use successor sets, scm is the mean
    of the Jaccard of successors and that of predecessors."""
    if measure not in MEASURES:
        raise ValueError(f"unknown similarity measure '{measure}'; known: {', '.join(MEASURES)}")
    links = edges.select(F.col("source").alias("x"), F.col("target").alias("y")).distinct()
    jaccard = lambda n, na, nb: n / (na + nb - n)
    if measure != "scm":
        n, na, nb = F.col("n_shared"), F.col("na"), F.col("nb")
        value = 2 * n / (na + nb) if measure == "uem" else jaccard(n, na, nb)
        return _met(links).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("n_shared")).select("a", "b", value.alias("similarity"))
    # both directions in one aggregation, so that a pair is shuffled once
    back = F.col("back")
    each = _met(links).withColumn("back", F.lit(False)).unionByName(_met(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).withColumn("back", F.lit(True)))
    sums = [f(side).alias(f"{name}{k}") for k, side in enumerate((~back, back)) for name, f in (("n", F.count_if), ("na", lambda s: F.max(F.when(s, F.col("na")))), ("nb", lambda s: F.max(F.when(s, F.col("nb")))))]
    parts = [F.coalesce(jaccard(F.col(f"n{k}"), F.col(f"na{k}"), F.col(f"nb{k}")), F.lit(0.0)) for k in (0, 1)]
    return each.groupBy("a", "b").agg(*sums).select("a", "b", ((parts[0] + parts[1]) / 2).alias("similarity"))
