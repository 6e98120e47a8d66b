"""Bounded traversal and change impact (T1-T6): one join per level, the frontier only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.storage import cut_lineage, maybe_broadcast, sized
from codestrata.functions.text import path_matches
from codestrata.model import Architecture, CodeGraph, component_edges


@dataclass
class Cone:
    nodes: DataFrame  # fqn, distance, via_relation
    truncated: bool


def walk_cone(edges: DataFrame, seeds: DataFrame, max_depth: int, max_nodes: int | None = None, valid: DataFrame | None = None) -> Cone:
    """Nodes within max_depth steps of the seeds, without the seeds. via_relation is the relation of the first hop of
    the shortest path that comes first by (seed name, edge order). Unknown nodes are walked through but, with
    `valid` (fqn), not reported. max_nodes keeps the closest by (distance, fqn)."""
    schema = "fqn string, distance int, via_relation string"
    spark = edges.sparkSession
    if max_depth < 1:
        return Cone(spark.createDataFrame([], schema), False)
    start = seeds.select("fqn").distinct()
    visited = cut_lineage(start.select("fqn", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("via_relation"), F.col("fqn").alias("seed"), F.array().cast("array<long>").alias("path")))
    frontier = visited
    for depth in range(1, max_depth + 1):
        step = edges.join(maybe_broadcast(frontier.select(F.col("fqn").alias("source"), F.col("via_relation").alias("via"), "seed", "path")), "source")
        # of all ways into a node the first: by its parent's way, then by the edge
        way = F.min(F.struct("seed", F.concat("path", F.array("edge_seq")).alias("path"), F.coalesce("via", "relation").alias("via")))
        found = step.groupBy(F.col("target").alias("fqn")).agg(way.alias("w")).join(visited.select("fqn"), "fqn", "left_anti")
        frontier = cut_lineage(found.select("fqn", F.lit(depth).alias("distance"), F.col("w.via").alias("via_relation"), "w.seed", "w.path"))
        if frontier.limit(1).count() == 0:
            break
        visited = visited.unionByName(frontier)
    out = visited.where("distance > 0").select("fqn", "distance", "via_relation")
    if valid is not None:
        out = out.join(sized(valid.select("fqn")), "fqn", "left_semi")
    if max_nodes is None:
        return Cone(out, False)
    return Cone(out.orderBy("distance", "fqn").limit(max_nodes), out.limit(max_nodes + 1).count() > max_nodes)


def resolve_seed(graph: CodeGraph, target: str) -> tuple[DataFrame, str | None, list[str]]:
    """(seeds, "entity", "file" or None, candidate files if that is ambiguous). An exact name, else an exact path, else the
    one file whose path ends so, or that ends the target."""
    e = graph.entities.select("fqn", F.regexp_replace("file_path", r"\\", "/").alias("file_path"))
    path = target.replace("\\", "/")
    for how, cond in (("entity", F.col("fqn") == target), ("file", F.col("file_path") == path)):
        hit = e.where(cond)
        if hit.limit(1).count():
            return hit.select("fqn"), how, []
    parts = path.strip("/").split("/")
    ends = ["/".join(parts[k:]) for k in range(len(parts))]
    hit = e.where(F.endswith("file_path", F.lit("/" + path.lstrip("/"))) | F.col("file_path").isin(ends))
    files = [r[0] for r in hit.select("file_path").distinct().orderBy("file_path").collect()]  # of one file name
    if len(files) > 1:
        return hit.select("fqn").limit(0), None, files
    return hit.select("fqn"), "file" if files else None, []


def cone_files(graph: CodeGraph, cone: DataFrame) -> DataFrame:
    """T4: the distinct files of reported nodes."""
    return graph.entities.join(cone.select("fqn"), "fqn", "left_semi").select("file_path").distinct()


def dependency_cone(graph: CodeGraph, target: str, direction: str = "both", max_depth: int = 3, max_nodes: int | None = None) -> dict:
    """T5: what an entity or file needs (upstream) and what needs it (downstream)."""
    if direction not in ("upstream", "downstream", "both"):
        return {"error": f"Unknown direction '{direction}'", "valid_directions": ["upstream", "downstream", "both"]}
    seeds, how, candidates = resolve_seed(graph, target)
    if candidates:
        return {"target": target, "ambiguous": True, "candidate_files": candidates}
    names = sorted(r["fqn"] for r in seeds.collect())  # the entities of one file
    out: dict = {"target": target, "matched_by": how, "seed_entities": names, "direction": direction, "max_depth": max_depth}
    if not names:
        return out | {"note": "nothing in the graph matches the target"}
    for side, edges in (("upstream", graph.edges), ("downstream", graph.reverse_edges())):
        if direction in (side, "both"):
            cone = walk_cone(edges, seeds, max_depth, max_nodes, graph.entities)
            nodes = [r.asDict() for r in cone.nodes.orderBy("distance", "fqn").collect()]
            files = [r[0] for r in cone_files(graph, cone.nodes).orderBy("file_path").collect()]
            out[side] = {"num_nodes": len(nodes), "truncated": cone.truncated, "nodes": nodes, "files": files}
    return out


def changed_entities(graph: CodeGraph, changed: DataFrame) -> DataFrame:
    """(fqn, changed) of entities whose file matches a changed path. Suffix pairs become equal keys: every
    end of an entity's path at a slash meets the changed path itself and the other way round, so no theta join is needed.
    Only the changed paths are ever broadcast; the ends of all paths look as small as the entities' file but are many times larger."""
    clean = lambda c: F.regexp_replace(c, r"\\", "/")
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda k: F.array_join(F.slice(F.split(c, "/"), k, 10_000), "/"))
    e = graph.entities.select("fqn", clean(F.col("file_path")).alias("p"))
    c = changed.select(F.col("file_path").alias("changed"), clean(F.col("file_path")).alias("q"))
    longer = e.select("fqn", F.explode(ends(F.col("p"))).alias("q")).join(sized(c), "q").select("fqn", "changed")
    shorter = e.join(sized(c.select("changed", F.explode(ends(F.col("q"))).alias("p"))), "p").select("fqn", "changed")
    return longer.unionAll(shorter).distinct()


def broken_contracts(graph: CodeGraph, changed: DataFrame) -> DataFrame:
    """Changed entities (fqn) that known entities outside of the change depend on: dependents (first 20) and their number."""
    changed = sized(cut_lineage(changed.select("fqn").distinct()))
    into = graph.edges.join(changed.withColumnRenamed("fqn", "target"), "target", "left_semi").join(changed.withColumnRenamed("fqn", "source"), "source", "left_anti")
    # few are left when all entities are asked whether they know the source
    found = into.select(F.col("target").alias("fqn"), "source").distinct().join(sized(graph.entities.select(F.col("fqn").alias("source"))), "source", "left_semi")
    first = F.row_number().over(Window.partitionBy("fqn").orderBy("source"))
    listed = found.withColumn("r", first).where("r <= 20").groupBy("fqn").agg(F.array_sort(F.collect_list("source")).alias("dependents"))
    return found.groupBy("fqn").agg(F.count("*").alias("num_dependents")).join(listed, "fqn")


def diff_impact(graph: CodeGraph, changed_files: list[str], arch: Architecture | None = None, max_depth: int = 3) -> dict:
    """What a change of files touches."""
    spark = graph.entities.sparkSession
    files = spark.createDataFrame([(f,) for f in changed_files], "file_path string")
    hit = cut_lineage(changed_entities(graph, files))
    names = sorted({r["fqn"] for r in hit.collect()})
    matched = sorted({r["changed"] for r in hit.select("changed").distinct().collect()})
    seeds = hit.select("fqn").distinct()
    down = walk_cone(graph.reverse_edges(), seeds, max_depth, None, graph.entities).nodes
    touched = [] if arch is None else sorted(r[0] for r in arch.membership_first().join(seeds, "fqn", "left_semi").select("component").distinct().collect())
    nodes = [r.asDict() for r in down.orderBy("distance", "fqn").collect()]
    return {
        "changed_files": changed_files, "matched_files": matched, "unmatched_files": [f for f in changed_files if f not in matched],
        "num_changed_entities": len(names), "changed_entities": names, "affected_components": touched, "downstream_dependents": nodes,
        "num_downstream": len(nodes), "broken_contracts": [r.asDict() for r in broken_contracts(graph, seeds).orderBy("fqn").collect()],
    }


__all__ = ["Cone", "broken_contracts", "changed_entities", "component_edges", "cone_files", "dependency_cone", "diff_impact", "path_matches", "resolve_seed", "walk_cone"]
