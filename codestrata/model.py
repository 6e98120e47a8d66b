"""Code graphs and architectures as bundles of DataFrames (M3-M5), and the views that most operators start from."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class CodeGraph:
    """entities are unique by fqn; edges are a multigraph that may point outside of them."""

    entities: DataFrame
    edges: DataFrame
    packages: DataFrame | None = None
    meta: dict[str, Any] = field(default_factory=dict)

    def package_rows(self) -> DataFrame:
        """(package, fqn, pos): given, or by the order of the entities."""
        if self.packages is not None:
            return self.packages
        pos = F.row_number().over(Window.partitionBy("package").orderBy("entity_seq")) - 1
        return self.entities.select("package", "fqn", pos.cast("long").alias("pos"))

    def known_edges(self) -> DataFrame:
        """Edges from a known entity (G5): unknown sources are dropped, unknown targets and repeats stay."""
        return self.edges.join(self.entities.select(F.col("fqn").alias("source")), "source", "left_semi")

    def inner_edges(self) -> DataFrame:
        """Edges between two known entities."""
        return self.known_edges().join(self.entities.select(F.col("fqn").alias("target")), "target", "left_semi").select("source", "target", "relation", "edge_seq")

    def reverse_edges(self) -> DataFrame:
        """The same edges the other way round."""
        return self.edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation", "edge_seq")


@dataclass
class Architecture:
    """Ordered components and their members; an entity may stand in several components."""

    components: DataFrame
    membership: DataFrame
    rationale: str = ""
    algorithm: str = ""
    meta: dict[str, Any] = field(default_factory=dict)

    def membership_first(self) -> DataFrame:
        """(fqn, component), the first component wins."""
        return self._one(F.asc("comp_seq"))

    def membership_last(self) -> DataFrame:
        """(fqn, component), the last component wins, as metrics count."""
        return self._one(F.desc("comp_seq"))

    def _one(self, order) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("fqn").orderBy(order))
        return self.membership.withColumn("_r", rank).where("_r = 1").select("fqn", F.col("name").alias("component"))

    def sizes(self) -> DataFrame:
        """(comp_seq, component, n): every component with its number of member rows, empty ones too."""
        n = self.membership.groupBy("comp_seq").agg(F.count("*").alias("n"))
        return self.components.join(n, "comp_seq", "left").select("comp_seq", F.col("name").alias("component"), F.coalesce("n", F.lit(0)).alias("n"))

    def component_of(self, fqn: str) -> DataFrame:
        """G10, Q1."""
        return self.membership_first().where(F.col("fqn") == fqn)


def mapped_edges(graph: CodeGraph, membership: DataFrame) -> DataFrame:
    """Edges with the components of both ends; edges with an end outside of all components are left out."""
    m = membership
    return (
        graph.edges.join(m.select(F.col("fqn").alias("source"), F.col("component").alias("src")), "source")
        .join(m.select(F.col("fqn").alias("target"), F.col("component").alias("tgt")), "target")
        .select("source", "target", "relation", "edge_seq", "src", "tgt")
    )


def component_edges(graph: CodeGraph, arch: Architecture) -> DataFrame:
    """Distinct ordered pairs of different, named components."""
    pairs = mapped_edges(graph, arch.membership_first()).where("src <> tgt and src <> '' and tgt <> ''")
    return pairs.select(F.col("src").alias("source"), F.col("tgt").alias("target")).distinct()


def edge_counts(graph: CodeGraph, arch: Architecture) -> DataFrame:
    """Edges (repeats count) by ordered pair of components; equal ends are the inner ones."""
    return mapped_edges(graph, arch.membership_last()).groupBy("src", "tgt").agg(F.count("*").alias("n_edges"))


def architecture_by(graph: CodeGraph, key, algorithm: str = "given") -> Architecture:
    """An architecture with one component for each value of `key`, a column of the entities, in ascending order."""
    rows = graph.entities.select("fqn", key.alias("name"), "entity_seq")
    names = rows.select("name").distinct()
    # one row per component, not per entity
    seq = (F.row_number().over(Window.orderBy("name")) - 1).cast("int")
    components = names.select(seq.alias("comp_seq"), "name", F.concat(F.lit("Entities of "), "name").alias("responsibility"))
    pos = (F.row_number().over(Window.partitionBy("name").orderBy("entity_seq")) - 1).cast("long")
    membership = rows.withColumn("member_pos", pos).join(components.select("comp_seq", "name"), "name").select("fqn", "comp_seq", "name", "member_pos")
    return Architecture(components, membership, algorithm=algorithm)
