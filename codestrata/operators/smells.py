"""Architectural smells (D1-D7): grouped counts with thresholds, and cycles of the component graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.storage import cut_lineage
from codestrata.model import Architecture, CodeGraph, component_edges

# Name endings, the first that fits counts.
SUFFIXES = (
    "Service Controller Repository Manager Handler Factory Listener Provider Adapter Helper Util Utils Config Configuration Exception Test Spec"
).split()


def reachable(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Pairs (source, target) connected by a path, by doubling path lengths. Meant for component graphs, whose
    closure is small; nodes that cannot lie on a cycle are best dropped before."""
    now = cut_lineage(edges.select("source", "target").distinct())
    n = now.count()
    for _ in range(max_rounds):
        longer = now.alias("a").join(now.alias("b"), F.col("a.target") == F.col("b.source")).select("a.source", "b.target")
        now = cut_lineage(now.unionAll(longer).distinct())
        after = now.count()
        if after == n:
            break
        n = after
    return now


def trim(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Edges without those at nodes that nothing enters or nothing leaves, repeatedly: no cycle is lost."""
    now = cut_lineage(edges.select("source", "target").where("source <> target").distinct())
    n = now.count()
    for _ in range(max_rounds):
        both = now.select(F.col("source").alias("x")).intersect(now.select(F.col("target").alias("x")))
        both = cut_lineage(both)
        now = cut_lineage(now.join(both.withColumnRenamed("x", "source"), "source", "left_semi").join(both.withColumnRenamed("x", "target"), "target", "left_semi").select("source", "target"))
        after = now.count()
        if after == n:
            break
        n = after
    return now


def strong_components(edges: DataFrame) -> DataFrame:
    """(scc, member) of strongly connected components of two nodes or more; scc is the first member by name."""
    paths = reachable(trim(edges))
    mutual = paths.alias("a").join(paths.alias("b"), (F.col("a.source") == F.col("b.target")) & (F.col("a.target") == F.col("b.source"))).select(F.col("a.source").alias("member"), F.col("a.target").alias("peer"))
    return mutual.groupBy("member").agg(F.least(F.min("peer"), F.first("member")).alias("scc"), F.count_distinct("peer").alias("n")).where("n > 1").select("scc", "member")


def dependency_cycles(graph: CodeGraph, arch: Architecture) -> DataFrame:
    """Affected (sorted), size, severity."""
    groups = strong_components(component_edges(graph, arch)).groupBy("scc").agg(F.array_sort(F.collect_set("member")).alias("affected"))
    size = F.size("affected")
    return groups.select("affected", size.alias("size"), F.when(size >= 5, "high").when(size >= 3, "medium").otherwise("low").alias("severity"))


def concern_overload(graph: CodeGraph, arch: Architecture, threshold: int = 20, high: int = 40, least_density: float = 0.4) -> DataFrame:
    """Large components with few edges inside. Inner edges count by the component's own members."""
    m = arch.membership.select("fqn", "comp_seq").distinct()
    inner = (
        graph.edges.join(m.select(F.col("fqn").alias("source"), "comp_seq"), "source")
        .join(m.select(F.col("fqn").alias("target"), F.col("comp_seq").alias("other")), "target")
        .where("comp_seq = other")
        .groupBy("comp_seq")
        .agg(F.count("*").alias("internal_edges"))
    )
    out = arch.sizes().where(F.col("n") > threshold).join(inner, "comp_seq", "left").withColumn("internal_edges", F.coalesce("internal_edges", F.lit(0)))
    density = F.col("internal_edges") / F.col("n")
    return out.where(density < least_density).select("component", F.col("n").alias("entity_count"), F.when(F.col("n") > high, "high").otherwise("medium").alias("severity"), "internal_edges", F.round(density, 2).alias("density"))


def scattered_functionality(graph: CodeGraph, arch: Architecture, min_components: int = 3, suffixes: list[str] | None = None) -> DataFrame:
    """Name endings that stand in several components."""
    suffix = F.coalesce(*[F.when(F.endswith(F.col("name"), F.lit(s)), s) for s in suffixes or SUFFIXES])
    named = graph.entities.select("fqn", suffix.alias("pattern")).where("pattern is not null")
    found = arch.membership.select("fqn", F.col("name").alias("component")).join(named, "fqn").groupBy("pattern").agg(F.array_sort(F.collect_set("component")).alias("components"))
    n = F.size("components")
    return found.where(n >= min_components).select("pattern", "components", n.alias("n_components"), F.when(n >= 5, "high").otherwise("medium").alias("severity"))


def link_overload(graph: CodeGraph, arch: Architecture) -> DataFrame:
    """Components that many of the others depend on; none in an architecture of two components or fewer."""
    k = arch.components.agg(F.count("*").alias("k"))
    into = component_edges(graph, arch).groupBy(F.col("target").alias("component")).agg(F.count("*").alias("dependents")).join(F.broadcast(k))  # k is one row
    ratio = F.col("dependents") / F.greatest(F.col("k") - 1, F.lit(1))
    return into.where((F.col("k") > 2) & (F.col("dependents") >= 3) & (ratio >= 0.5)).select("component", "dependents", F.round(ratio, 4).alias("ratio"), F.when(ratio >= 0.75, "high").otherwise("medium").alias("severity"))


def detect(graph: CodeGraph, arch: Architecture, concerns: Callable[[CodeGraph, Architecture], DataFrame] | None = None) -> DataFrame:
    """All smells in the order of their detectors. `concerns`, if given, takes the place of the two concern
    detectors and returns rows of the same columns; without a provider nothing is asked of a model."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    cycles = dependency_cycles(graph, arch).select(
        F.lit(0).alias("detector_seq"), F.lit("dependency_cycle").alias("smell_type"), "severity", "affected",
        text("Cycle of ", F.col("size"), " components: ", F.array_join("affected", ", ")).alias("description"),
        F.lit("None of these components can be understood, tested or released without the others.").alias("explanation"),
        F.lit("Turn one dependency around or move what is shared into a component of its own.").alias("suggestion"),
    )
    if concerns is None:
        over = concern_overload(graph, arch).select(
            F.lit(1).alias("detector_seq"), F.lit("concern_overload").alias("smell_type"), "severity", F.array("component").alias("affected"),
            text(F.col("component"), " holds ", F.col("entity_count"), " entities with few links among them").alias("description"),
            F.lit("It probably serves several purposes at once.").alias("explanation"), F.lit("Split it along the groups that work together.").alias("suggestion"),
        )
        scattered = scattered_functionality(graph, arch).select(
            F.lit(2).alias("detector_seq"), F.lit("scattered_functionality").alias("smell_type"), "severity", F.col("components").alias("affected"),
            text("Names in ", F.col("pattern"), " stand in ", F.col("n_components"), " components").alias("description"),
            F.lit("One kind of work is spread over the architecture.").alias("explanation"), F.lit("Bring it together or give it a shared base.").alias("suggestion"),
        )
        middle = over.unionByName(scattered)
    else:
        middle = concerns(graph, arch)
    links = link_overload(graph, arch).select(
        F.lit(3).alias("detector_seq"), F.lit("link_overload").alias("smell_type"), "severity", F.array("component").alias("affected"),
        text(F.col("dependents"), " components depend on ", F.col("component")).alias("description"),
        F.lit("Every change to it can reach most of the system.").alias("explanation"), F.lit("Split its interface by client.").alias("suggestion"),
    )
    return cycles.unionByName(middle).unionByName(links)


def counted(smells: DataFrame) -> DataFrame:
    """What the burden needs of each smell."""
    return smells.select("smell_type", "severity", F.size("affected").alias("n_affected"))
