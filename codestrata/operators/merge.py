"""Union and linking of graphs across languages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.storage import cut_lineage
from codestrata.model import CodeGraph


def family(language: Column) -> Column:
    """G3."""
    low = F.lower(language)
    return F.when(low.isin("java", "kotlin"), "jvm").otherwise(F.coalesce(low, F.lit("unknown")))


def _numbered(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.withColumn("g", F.lit(k)) for k, f in enumerate(frames)])


def union(graphs: list[CodeGraph]) -> CodeGraph:
    """G1: the later entity wins at the place of the first; edges are all kept; package lists are joined in order."""
    e = _numbered([g.entities for g in graphs])
    w = Window.partitionBy("fqn")
    place = F.min(F.struct("g", "entity_seq")).over(w)
    last = F.row_number().over(w.orderBy(F.desc("g"), F.desc("entity_seq")))
    e = e.withColumns({"_place": place, "_r": last}).where("_r = 1")
    e = e.withColumn("entity_seq", F.col("_place.g") * F.lit(1 << 40) + F.col("_place.entity_seq")).drop("g", "_place", "_r")
    edges = _numbered([g.edges for g in graphs]).withColumn("edge_seq", F.col("g") * F.lit(1 << 40) + F.col("edge_seq")).drop("g")
    p = _numbered([g.package_rows() for g in graphs])
    p = p.groupBy("package", "fqn").agg(F.min(F.col("g") * F.lit(1 << 40) + F.col("pos")).alias("pos"))
    return CodeGraph(e, edges, p)


def collisions(graphs: list[CodeGraph]) -> DataFrame:
    """One row per entity of the numbered union: g, fqn, language, owner_language (that of the first with this name),
    kept, new_fqn (for later ones of another family, numbered within fqn and language)."""
    e = _numbered([g.entities.select("fqn", "language", "entity_seq") for g in graphs])
    w = Window.partitionBy("fqn").orderBy("g", "entity_seq")
    e = e.withColumns({"owner_language": F.first("language", ignorenulls=False).over(w), "n": F.row_number().over(w)})
    same = family(F.col("owner_language")) == family(F.col("language"))
    e = e.withColumn("same", same)
    foreign = F.sum(F.when(~F.col("same"), 1).otherwise(0)).over(Window.partitionBy("fqn", "language").orderBy("g", "entity_seq"))
    key = F.concat("fqn", F.lit("#"), "language")
    new = F.when(F.col("same"), F.col("fqn")).when(foreign == 1, key).otherwise(F.concat(key, foreign.cast("string")))
    return e.select("g", "fqn", "language", "owner_language", "entity_seq", ((F.col("n") == 1) | ~F.col("same")).alias("kept"), new.alias("new_fqn"), "same")


def merge(graphs: list[CodeGraph]) -> CodeGraph:
    """Within a family the first entity of a name wins, across families the later one is kept under
    `name#language`; its edges and package rows follow it; then resolvable edges are added."""
    found = cut_lineage(collisions(graphs))
    row = found.agg(
        F.count_if(~F.col("kept") & F.col("same") & (F.col("language") != F.col("owner_language"))).alias("same"), F.count_if(~F.col("same")).alias("cross")
    ).first()
    meta = {"fqn_collisions": row["same"] + row["cross"], "fqn_collisions_same_family": row["same"], "fqn_collisions_cross_family": row["cross"]}
    names = found.select("g", "fqn", "new_fqn", "kept", "entity_seq")
    e = _numbered([g.entities for g in graphs]).join(names.where("kept"), ["g", "fqn", "entity_seq"])
    e = e.withColumn("entity_seq", F.col("g") * F.lit(1 << 40) + F.col("entity_seq")).withColumn("fqn", F.col("new_fqn")).drop("g", "new_fqn", "kept")
    renamed = names.where("fqn <> new_fqn").select("g", "fqn", "new_fqn").distinct()

    def remap(df: DataFrame, column: str) -> DataFrame:
        r = renamed.select("g", F.col("fqn").alias(column), F.col("new_fqn").alias("_new"))
        return df.join(r, ["g", column], "left").withColumn(column, F.coalesce("_new", column)).drop("_new")

    edges = remap(remap(_numbered([g.edges for g in graphs]), "source"), "target").select("source", "target", "relation", (F.col("g") * F.lit(1 << 40) + F.col("edge_seq")).alias("edge_seq"))
    p = remap(_numbered([g.package_rows() for g in graphs]), "fqn")
    p = p.groupBy("package", "fqn").agg(F.min(F.col("g") * F.lit(1 << 40) + F.col("pos")).alias("pos"))
    graph = CodeGraph(e, edges, p, meta)
    return CodeGraph(e, relinked(graph), p, meta)


def link_candidates(entities: DataFrame) -> DataFrame:
    """(source, target, relation): import, extends and implements links that can be resolved within a language family. The ways
    to resolve a name are a union of equi-joins, of which the first that gives a target counts: the name itself, an
    alias, the end of an import, the same package, and, for names without a dot, the only entity so called."""
    e = entities.withColumn("fam", family(F.col("language")))
    ids = e.select(F.col("fqn").alias("target"), F.col("fam").alias("tfam"))
    leaf = F.element_at(F.split("fqn", r"[.:]+"), -1)
    leaves = e.groupBy("fam", leaf.alias("leaf")).agg(F.count("*").alias("n"), F.min("fqn").alias("target")).where("n = 1").select(F.col("fam").alias("lfam"), "leaf", "target")

    imports = e.select(F.col("fqn").alias("source"), "fam", F.explode("imports").alias("name"))
    direct = imports.join(ids, F.col("name") == F.col("target"), "left")
    by_name = direct.where("target is not null and tfam = fam").select("source", "target")
    by_leaf = direct.where("target is null and not contains(name, '.')").drop("target").join(leaves, (F.col("lfam") == F.col("fam")) & (F.col("leaf") == F.col("name"))).select("source", "target")
    out = by_name.unionByName(by_leaf).withColumn("relation", F.lit("import"))

    wanted = e.where("superclass is not null and superclass <> ''").select(F.col("fqn").alias("source"), "fam", "package", "imports", F.col("superclass").alias("name"), F.lit("extends").alias("relation"), *_alias(e))
    wanted = wanted.unionByName(e.select(F.col("fqn").alias("source"), "fam", "package", "imports", F.explode("interfaces").alias("name"), F.lit("implements").alias("relation"), *_alias(e)))
    ways = [
        wanted.withColumns({"try": F.col("name"), "way": F.lit(0)}),
        wanted.withColumns({"try": F.try_element_at("aliases", F.col("name")), "way": F.lit(1)}),
        wanted.withColumns({"try": F.explode(F.filter("imports", lambda i: F.endswith(i, F.concat(F.lit("."), F.col("name"))))), "way": F.lit(2)}),
        wanted.withColumns({"try": F.when(F.col("package") != "", F.concat("package", F.lit("."), "name")), "way": F.lit(3)}),
    ]
    tried = reduce(DataFrame.unionByName, ways).join(ids, (F.col("try") == F.col("target")) & (F.col("fam") == F.col("tfam"))).select("source", "name", "relation", "way", "target")
    last = wanted.where("not contains(name, '.')").join(leaves, (F.col("lfam") == F.col("fam")) & (F.col("leaf") == F.col("name"))).select("source", "name", "relation", F.lit(4).alias("way"), "target")
    best = tried.unionByName(last).groupBy("source", "name", "relation").agg(F.min(F.struct("way", "target")).alias("b")).select("source", "b.target", "relation")
    return out.unionByName(best).where("source <> target").distinct()


def _alias(e: DataFrame) -> list[Column]:
    return [F.col("import_aliases").alias("aliases")] if "import_aliases" in e.columns else [F.lit(None).cast("map<string,string>").alias("aliases")]


def relinked(graph: CodeGraph) -> DataFrame:
    """The edges with resolvable ones added; running it again adds nothing."""
    new = link_candidates(graph.entities).join(graph.edges.select("source", "target", "relation"), ["source", "target", "relation"], "left_anti")
    return graph.edges.unionByName(new.withColumn("edge_seq", F.lit(1 << 50) + F.pmod(F.xxhash64("source", "target", "relation"), F.lit(1 << 40))))
