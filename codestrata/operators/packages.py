"""Recovery of components from packages (R1): one plan, with decisions on the grouping as it first stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.text import component_title
from codestrata.model import Architecture, CodeGraph


def common_prefix(entities: DataFrame) -> list[str]:
    """The segments that all packages start with. That of a set is that of its least and greatest array."""
    row = entities.where("package <> ''").select(F.split("package", r"\.").alias("p")).agg(F.min("p").alias("a"), F.max("p").alias("b")).first()
    out: list[str] = []
    for x, y in zip(row["a"] or [], row["b"] or []):
        if x != y:
            break
        out.append(x)
    return out


def _rest(column: str, prefix: int) -> Column:
    return F.slice(F.split(column, r"\."), prefix + 1, 10_000)


def auto_depth(entities: DataFrame, prefix: int) -> int:
    """The first depth up to 4 with five distinct keys, all depths counted in one pass."""
    rest = _rest("package", prefix)
    key = lambda d: F.when(F.size(rest) > 0, F.array_join(F.slice(rest, 1, d), ".")).otherwise(F.element_at(F.split("package", r"\."), -1))
    row = entities.where("package <> ''").agg(F.count("*").alias("n"), *[F.count_distinct(key(d)).alias(f"d{d}") for d in (1, 2, 3, 4)]).first()
    if row["n"] == 0:
        return 2
    return next((d for d in (1, 2, 3) if row[f"d{d}"] >= 5), 4)


def package_groups(entities: DataFrame, prefix: int, depth: int) -> DataFrame:
    """(fqn, grp, entity_seq). A package equal to the prefix gives the key to the name itself."""
    rest, own = _rest("package", prefix), _rest("fqn", prefix)
    key = (
        F.when(F.coalesce(F.col("package"), F.lit("")) == "", "(default)")
        .when(F.size(rest) > 0, F.array_join(F.slice(rest, 1, depth), "."))
        .when(F.size(own) > 0, F.array_join(F.slice(own, 1, depth), "."))
        .otherwise(F.element_at(F.split("package", r"\."), -1))
    )
    return entities.select("fqn", key.alias("grp"), "entity_seq")


def _grouped_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    g = groups.select("fqn", "grp")
    return edges.join(g.select(F.col("fqn").alias("source"), F.col("grp").alias("src")), "source").join(g.select(F.col("fqn").alias("target"), F.col("grp").alias("tgt")), "target")


def utility_hubs(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """R1d: (fqn) with two edges or more from their own group and none across groups."""
    e = _grouped_edges(edges, groups)
    same = F.col("src") == F.col("tgt")
    touched = e.select(F.col("target").alias("fqn"), same.cast("int").alias("inside"), (~same).cast("int").alias("across")).unionAll(e.where(~same).select(F.col("source").alias("fqn"), F.lit(0), F.lit(1)))
    return touched.groupBy("fqn").agg(F.sum("inside").alias("i"), F.sum("across").alias("a")).where("i >= 2 and a = 0").select("fqn")


def facade_moves(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """R1e: (fqn, grp, to_grp) of thin facades: in a group of several, no links to peers but through hubs, nothing from other
    groups, and all known dependencies in one other group."""
    hubs = utility_hubs(edges, groups).withColumn("hub", F.lit(True))
    e = _grouped_edges(edges, groups)
    out = e.select(F.col("source").alias("fqn"), F.col("target").alias("other"), F.col("src").alias("own"), F.col("tgt").alias("far"), F.lit(True).alias("out"))
    into = e.select(F.col("target").alias("fqn"), F.col("source").alias("other"), F.col("tgt").alias("own"), F.col("src").alias("far"), F.lit(False).alias("out"))
    both = out.unionAll(into).join(hubs.withColumnRenamed("fqn", "other"), "other", "left")
    peer = (F.col("own") == F.col("far")) & F.col("hub").isNull()
    other = F.col("own") != F.col("far")
    facts = both.groupBy("fqn", "own").agg(
        F.max(peer.cast("int")).alias("peers"),
        F.max((other & ~F.col("out")).cast("int")).alias("foreign_in"),
        F.count_distinct(F.when(other & F.col("out"), F.col("far"))).alias("targets"),
        F.max(F.when(other & F.col("out"), F.col("far"))).alias("to_grp"),
    )
    several = groups.groupBy(F.col("grp").alias("own")).agg(F.count("*").alias("n")).where("n > 1").select("own")
    return facts.where("peers = 0 and foreign_in = 0 and targets = 1").join(several, "own", "left_semi").select("fqn", F.col("own").alias("grp"), "to_grp")


def refined_groups(edges: DataFrame, groups: DataFrame) -> DataFrame:
    moves = facade_moves(edges, groups).select("fqn", "to_grp")
    return groups.join(moves, "fqn", "left").select("fqn", F.coalesce("to_grp", "grp").alias("grp"), "entity_seq")


def unique_names(bases: list[str]) -> list[str]:
    """R1f: the bases in order, repeats with the next number that gives a name not taken yet."""
    taken: set[str] = set()
    out = []
    for base in bases:
        name, n = base, 1
        while name in taken:
            n += 1
            name = f"{base}{n}"
        taken.add(name)
        out.append(name)
    return out


def recover_packages(graph: CodeGraph, depth: int | None = None) -> Architecture:
    """R1."""
    spark = graph.entities.sparkSession
    prefix = common_prefix(graph.entities)
    depth = auto_depth(graph.entities, len(prefix)) if depth is None else depth
    groups = package_groups(graph.entities, len(prefix), depth)
    moved = facade_moves(graph.edges, groups).count()
    groups = refined_groups(graph.edges, groups)
    # names of components, one row each
    keys = [(r["grp"], r["title"]) for r in groups.select("grp").distinct().withColumn("title", component_title(F.col("grp"))).orderBy("grp").collect()]
    names = unique_names([t for _, t in keys])
    rows = [(k, key, name, f"Entities in {key}") for k, ((key, _), name) in enumerate(zip(keys, names))]
    named = spark.createDataFrame(rows, "comp_seq int, grp string, name string, responsibility string")
    pos = (F.row_number().over(Window.partitionBy("comp_seq").orderBy("fqn")) - 1).cast("long")
    membership = groups.join(named, "grp").select("fqn", "comp_seq", "name").withColumn("member_pos", pos)
    rationale = f"Package-based grouping (depth={depth} after common prefix '{'.'.join(prefix)}')" + (f" with dependency-affinity facade refinement ({moved} entities reassigned)." if moved else ".")
    return Architecture(named.select("comp_seq", "name", "responsibility"), membership, rationale, "pkg")
