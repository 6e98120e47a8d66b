"""Questions about a graph and its architecture."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.model import Architecture, CodeGraph, component_edges, mapped_edges

# Names of entry points.
ENTRY_POINTS = ("Main", "App", "Application", "Server", "CLI", "main", "app", "server", "cli", "run", "start", "Controller", "Handler", "Router", "Gateway")
QUESTIONS = {
    "component_of": "the component of an entity (entity)",
    "dependencies": "the components that a component depends on (component)",
    "dependents": "the components that depend on a component (component)",
    "entities": "the entities of a component (component)",
    "most_coupled": "the ten pairs of components with the most edges",
    "summary": "counts and components",
    "largest": "the ten largest components",
}


def most_coupled(graph: CodeGraph, arch: Architecture, n: int = 10) -> DataFrame:
    """Q5."""
    pairs = mapped_edges(graph, arch.membership_first()).where("src <> tgt").groupBy("src", "tgt").agg(F.count("*").alias("n_edges"), F.min("edge_seq").alias("first"))
    return pairs.orderBy(F.desc("n_edges"), "first", "src", "tgt").limit(n).select(F.col("src").alias("source"), F.col("tgt").alias("target"), "n_edges")


def largest(arch: Architecture, n: int = 10) -> DataFrame:
    """Q7."""
    return arch.sizes().orderBy(F.desc("n"), "comp_seq").limit(n).select("component", F.col("n").alias("num_entities"))


def arch_summary(graph: CodeGraph, arch: Architecture) -> DataFrame:
    """Q6: one row of counts."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(arch.components, "num_components")
    for df, name in ((graph.entities, "num_entities"), (graph.edges, "num_edges"), (component_edges(graph, arch), "num_component_edges")):
        out = out.join(F.broadcast(one(df, name)))  # one row each
    return out


def query(graph: CodeGraph, arch: Architecture, question: str, entity: str | None = None, component: str | None = None) -> dict:
    """Q1-Q8: answers to named questions as plain values; errors are values too."""
    if question not in QUESTIONS:
        return {"error": f"Unknown question '{question}'", "available_questions": QUESTIONS}
    if question == "component_of":
        if not entity:
            return {"error": "entity is required"}
        row = arch.component_of(entity).first()
        return {"entity": entity, "component": row["component"] if row else None}
    if question in ("dependencies", "dependents", "entities"):
        if not component:
            return {"error": "component is required"}
        if question == "entities":
            names = [r[0] for r in arch.membership.where(F.col("name") == component).select("fqn").distinct().orderBy("fqn").collect()]
            if not names and not arch.components.where(F.col("name") == component).limit(1).count():
                return {"error": f"Component '{component}' not found"}
            return {"component": component, "entities": names, "count": len(names)}
        near, far = ("source", "target") if question == "dependencies" else ("target", "source")
        names = [r[0] for r in component_edges(graph, arch).where(F.col(near) == component).select(far).distinct().orderBy(far).collect()]
        return {"component": component, question: names}
    if question == "most_coupled":
        return {"most_coupled": [r.asDict() for r in most_coupled(graph, arch).collect()]}
    if question == "largest":
        return {"largest": [r.asDict() for r in largest(arch).collect()]}
    return arch_summary(graph, arch).first().asDict() | {"components": [r.asDict() for r in arch.sizes().orderBy("comp_seq").collect()]}


def component_boundary(graph: CodeGraph, arch: Architecture) -> DataFrame:
    """Q9 for every component: inner, incoming and outgoing edges (ends outside of all components count too), the number of
    members that outsiders use, and the share of inner edges."""
    m = arch.membership.select("fqn", "comp_seq").distinct()
    out_of = graph.edges.join(m.withColumnRenamed("fqn", "source"), "source")
    into = graph.edges.join(m.withColumnRenamed("fqn", "target"), "target")
    key = ["source", "target", "relation", "comp_seq"]
    inner = out_of.select(*key).join(into.select(*key), key)
    leaving = out_of.select(*key).join(m.withColumnRenamed("fqn", "target"), ["target", "comp_seq"], "left_anti")
    entering = into.select(*key).join(m.withColumnRenamed("fqn", "source"), ["source", "comp_seq"], "left_anti")
    n = lambda df, name: df.groupBy("comp_seq").agg(F.count("*").alias(name))
    used = entering.groupBy("comp_seq").agg(F.count("*").alias("incoming_edges"), F.count_distinct("target").alias("api_size"))
    out = arch.sizes()
    for part in (n(inner, "internal_edges"), n(leaving, "outgoing_edges"), used):
        out = out.join(part, "comp_seq", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("internal_edges", "outgoing_edges", "incoming_edges", "api_size")})
    total = F.col("internal_edges") + F.col("incoming_edges") + F.col("outgoing_edges")
    return out.select("component", F.col("n").alias("num_entities"), "internal_edges", "incoming_edges", "outgoing_edges", "api_size", F.round(F.when(total > 0, F.col("internal_edges") / total).otherwise(1.0), 3).alias("cohesion"))


def explain_component(graph: CodeGraph, arch: Architecture, component: str) -> dict:
    """Q9 for one component, with its names."""
    row = arch.components.where(F.col("name") == component).orderBy("comp_seq").first()
    if row is None:
        return {"error": f"Component '{component}' not found", "available": [r["name"] for r in arch.components.orderBy("comp_seq").collect()]}
    mine = arch.membership.where(F.col("comp_seq") == row["comp_seq"]).select("fqn").distinct()
    one = Architecture(arch.components.where(F.col("comp_seq") == row["comp_seq"]), arch.membership.where(F.col("comp_seq") == row["comp_seq"]))
    facts = component_boundary(graph, one).first().asDict()
    into = graph.edges.join(mine.withColumnRenamed("fqn", "target"), "target", "left_semi").join(mine.withColumnRenamed("fqn", "source"), "source", "left_anti")
    out_of = graph.edges.join(mine.withColumnRenamed("fqn", "source"), "source", "left_semi").join(mine.withColumnRenamed("fqn", "target"), "target", "left_anti")
    names = lambda df: sorted(r[0] for r in df.distinct().collect())
    first = arch.membership_first()
    used = names(into.select("target"))
    members = graph.entities.join(mine, "fqn", "left_semi").select("fqn", "name", "kind", "file_path").orderBy("fqn")
    return {
        "name": component, "responsibility": row["responsibility"], "num_entities": mine.count(), "entities": [r.asDict() for r in members.collect()],
        "api_surface": used, "internal_only": sorted(set(names(mine)) - set(used)),
        "depends_on": names(out_of.join(first, F.col("target") == F.col("fqn")).select("component")), "depended_on_by": names(into.join(first, F.col("source") == F.col("fqn")).select("component")),
        **{k: facts[k] for k in ("internal_edges", "incoming_edges", "outgoing_edges", "cohesion")},
    }


def api_surface(graph: CodeGraph, scope: str | None = None) -> DataFrame:
    """Q10: public entities without an owner (package, fqn, name, kind, depended_on, n_members, members). Public is a name
    without a leading underscore; scope is a plain prefix of the package; depended_on: an edge from another file or
    from an unknown source."""
    e = graph.entities if scope is None else graph.entities.where(F.startswith("package", F.lit(scope)))
    public = e.where(~F.startswith("name", F.lit("_")))
    files = graph.entities.select("fqn", "file_path")
    into = graph.edges.join(files.select(F.col("fqn").alias("target"), F.col("file_path").alias("tf")), "target").join(files.select(F.col("fqn").alias("source"), F.col("file_path").alias("sf")), "source", "left")
    used = into.where("sf is null or sf <> tf").select(F.col("target").alias("fqn")).distinct().withColumn("used", F.lit(True))
    members = public.where("owner is not null").groupBy(F.col("owner").alias("fqn")).agg(F.count("*").alias("n_members"), F.array_sort(F.collect_list(F.struct("fqn", "name", "kind"))).alias("members"))
    return (
        public.where("owner is null").join(used, "fqn", "left").join(members, "fqn", "left")
        .select("package", "fqn", "name", "kind", F.coalesce("used", F.lit(False)).alias("depended_on"), F.coalesce("n_members", F.lit(0)).alias("n_members"), "members")
    )


def hotspots(graph: CodeGraph, n: int = 10) -> DataFrame:
    """Known entities by degree; zero counts."""
    into = graph.edges.groupBy(F.col("target").alias("fqn")).agg(F.count("*").alias("in_degree"))
    out_of = graph.edges.groupBy(F.col("source").alias("fqn")).agg(F.count("*").alias("out_degree"))
    e = graph.entities.select("fqn", "entity_seq").join(into, "fqn", "left").join(out_of, "fqn", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("in_degree", "out_degree")})
    return e.withColumn("degree", F.col("in_degree") + F.col("out_degree")).orderBy(F.desc("degree"), "entity_seq").limit(n).select("fqn", "in_degree", "out_degree", "degree")


def package_tree(graph: CodeGraph) -> DataFrame:
    """(package, kind, n_kind, n_entities): list length, and known members by kind."""
    rows = graph.package_rows()
    length = rows.groupBy("package").agg(F.count("*").alias("n_entities"))
    kinds = rows.join(graph.entities.select("fqn", "kind"), "fqn").groupBy("package", "kind").agg(F.count("*").alias("n_kind"))
    return length.join(kinds, "package", "left").select("package", "kind", F.coalesce("n_kind", F.lit(0)).alias("n_kind"), "n_entities")


def entry_points(graph: CodeGraph, names: tuple[str, ...] = ENTRY_POINTS) -> DataFrame:
    """Q12."""
    return graph.entities.where(F.col("name").isin(*names)).select("fqn", "name", "kind", "file_path")


def package_drilldown(graph: CodeGraph, package: str) -> DataFrame:
    """Q13 in counts: entities, boundary edges both ways, and files of a package and those below it."""
    mine = graph.entities.where((F.col("package") == package) | F.startswith("package", F.lit(package + ".")))
    s, t = mine.select(F.col("fqn").alias("source")), mine.select(F.col("fqn").alias("target"))
    out_of = graph.edges.join(s, "source", "left_semi").join(t, "target", "left_anti").agg(F.count("*").alias("num_deps_out"))
    into = graph.edges.join(t, "target", "left_semi").join(s, "source", "left_anti").agg(F.count("*").alias("num_deps_in"))
    n = mine.agg(F.count("*").alias("num_entities"), F.count_distinct("file_path").alias("num_files"))
    return n.join(F.broadcast(into)).join(F.broadcast(out_of)).select(F.lit(package).alias("package"), "num_entities", "num_files", "num_deps_in", "num_deps_out")  # one row each


def summarize(graph: CodeGraph, project: str = "", focus: str | None = None) -> dict:
    """Q11, Q13: an overview, or one package in detail."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    if focus is not None:
        counts = package_drilldown(graph, focus).first()
        if counts["num_entities"] == 0:
            return {"error": f"No entities found for package '{focus}'"}
        mine = graph.entities.where((F.col("package") == focus) | F.startswith("package", F.lit(focus + ".")))
        s, t = mine.select(F.col("fqn").alias("source")), mine.select(F.col("fqn").alias("target"))
        edge = ["source", "target", "relation"]
        return counts.asDict() | {
            "entities": rows(mine.select("fqn", "name", "kind", "file_path").orderBy("fqn")),
            "dependencies_in": rows(graph.edges.join(t, "target", "left_semi").join(s, "source", "left_anti").select(*edge).orderBy(*edge)),
            "dependencies_out": rows(graph.edges.join(s, "source", "left_semi").join(t, "target", "left_anti").select(*edge).orderBy(*edge)),
            "files": [r[0] for r in mine.select("file_path").distinct().orderBy("file_path").collect()],
        }
    language = graph.entities.groupBy("language").agg(F.count("*").alias("n"), F.min("entity_seq").alias("s")).orderBy(F.desc("n"), "s").first()
    return {
        "project": project, "language": language["language"] if language else None, "num_entities": graph.entities.count(), "num_edges": graph.edges.count(),
        "num_packages": graph.package_rows().select("package").distinct().count(), "entity_kinds": {r["kind"]: r["n"] for r in kind_counts(graph.entities).collect()},
        "packages": rows(package_tree(graph).orderBy("package", "kind")), "hotspots": rows(hotspots(graph)), "entry_points": rows(entry_points(graph).orderBy("fqn")),
    }


def kind_counts(entities: DataFrame) -> DataFrame:
    """G16."""
    return entities.groupBy("kind").agg(F.count("*").alias("n"))


def component_kinds(graph: CodeGraph, arch: Architecture) -> DataFrame:
    """Kinds per component; an entity counts if it or its owner is a member. The OR is a union of two equi-joins."""
    e = graph.entities.select("fqn", "owner", "kind")
    m = arch.membership.select(F.col("fqn").alias("member"), F.col("name").alias("component"))
    own = e.join(m, F.col("fqn") == F.col("member")).select("component", "fqn", "kind")
    owned = e.join(m, F.col("owner") == F.col("member")).select("component", "fqn", "kind")
    return own.union(owned).distinct().groupBy("component", "kind").agg(F.count("*").alias("n"))


def architectural(graph: CodeGraph, registration: tuple[str, ...] = ()) -> CodeGraph:
    """Without methods, private Python functions, and same-package imports of registration helpers (by name)."""
    keep = graph.entities.where(~((F.col("kind") == "method") | ((F.col("language") == "python") & (F.col("kind") == "function") & F.startswith("name", F.lit("_")))))
    names = keep.select("fqn")
    edges = graph.edges.join(names.select(F.col("fqn").alias("source")), "source", "left_semi").join(names.select(F.col("fqn").alias("target")), "target", "left_semi")
    if registration:
        p = keep.select("fqn", "package", "name")
        helper = p.where(F.col("name").isin(*registration)).select(F.col("fqn").alias("target"), F.col("package").alias("tp"))
        edges = edges.join(helper, "target", "left").join(p.select(F.col("fqn").alias("source"), F.col("package").alias("sp")), "source", "left")
        edges = edges.where(~F.coalesce((F.col("relation") == "import") & (F.col("sp") == F.col("tp")), F.lit(False))).select("source", "target", "relation", "edge_seq")
    packages = graph.package_rows().join(names, "fqn", "left_semi").select("package", "fqn", "pos")
    return CodeGraph(keep, edges, packages, dict(graph.meta))


def graph_summary(graph: CodeGraph) -> DataFrame:
    """G18 in counts: one row."""
    n = graph.entities.agg(F.count("*").alias("num_entities"), F.count_if(F.col("kind") == "method").alias("method_count"), F.count_if(F.col("kind") == "function").alias("function_count"), F.count_if(F.col("kind") == "class").alias("class_count"))
    edges = graph.edges.agg(F.count("*").alias("num_edges"))
    packages = graph.package_rows().agg(F.count_distinct("package").alias("num_packages"))
    return n.join(F.broadcast(edges)).join(F.broadcast(packages))  # one row each


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Window", "annotations")]
