"""Pass 2 of parsing: facts of all files to a graph, by joins on names (P1-P6). It is always run in full."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.storage import cut_lineage
from codestrata.model import CodeGraph


def _entities(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity rows unique by fqn, every declaration in order). The last declaration wins at the place of the first."""
    rows = facts.where("error is null").select("rel_path", "language", "package", "imports", "aliases", F.posexplode("entities").alias("pos", "e"))
    rows = rows.select("rel_path", "language", "package", F.col("imports").alias("file_imports"), "aliases", "pos", "e.*")
    # the order of (path, position) as one number: files by rank, at most 2**20 declarations each
    order = facts.select("rel_path").distinct().withColumn("file_seq", F.row_number().over(Window.orderBy("rel_path")).cast("long"))
    rows = rows.join(order, "rel_path").withColumn("seq", F.col("file_seq") * (1 << 20) + F.col("pos"))
    w = Window.partitionBy("fqn")
    unique = rows.withColumns({"entity_seq": F.min("seq").over(w), "_last": F.max("seq").over(w)}).where("seq = _last").drop("_last")
    return unique, rows


def _simple(e: DataFrame) -> DataFrame:
    """Simple-name index of a language: the last declaration counts."""
    return e.groupBy(F.col("language").alias("ilang"), F.col("name").alias("iname")).agg(F.max_by("fqn", "entity_seq").alias("target"))


def _best(tried: list[DataFrame], key: list[str]) -> DataFrame:
    """Of the targets that several ways give, the one of the first way."""
    rows = reduce(DataFrame.unionByName, [t.select(*key, "target", F.lit(k).alias("way")) for k, t in enumerate(tried)])
    return rows.groupBy(*key).agg(F.min(F.struct("way", "target")).alias("b")).select(*key, "b.target")


def _leaf(name: str | Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def jvm_edges(e: DataFrame) -> DataFrame:
    e = e.where(F.col("language").isin("java", "kotlin"))
    ids, simple = e.select(F.col("fqn").alias("target"), F.col("language").alias("ilang")), _simple(e)
    imports = e.select(F.col("fqn").alias("source"), "language", F.explode("imports").alias("name"))
    exact = imports.join(ids, (F.col("name") == F.col("target")) & (F.col("language") == F.col("ilang")))
    by_leaf = imports.join(simple, (_leaf("name") == F.col("iname")) & (F.col("language") == F.col("ilang"))).where("source <> target")
    out = _best([exact, by_leaf], ["source", "name"]).select("source", "target", F.lit("import").alias("relation"))

    parents = e.where("superclass is not null").select(F.col("fqn").alias("source"), "language", "package", "imports", "aliases", F.col("superclass").alias("name"), F.lit("extends").alias("relation"))
    parents = parents.unionByName(e.select(F.col("fqn").alias("source"), "language", "package", "imports", "aliases", F.explode("interfaces").alias("name"), F.lit("implements").alias("relation")))
    at = lambda c: parents.withColumn("try", c).join(ids, (F.col("try") == F.col("target")) & (F.col("language") == F.col("ilang")))
    suffix = F.explode(F.filter("imports", lambda i: F.endswith(i, F.concat(F.lit("."), F.col("name")))))
    # a qualified Kotlin name never falls back to its leaf
    bare = parents.where("language = 'java' or not contains(name, '.')").join(simple, (F.col("name") == F.col("iname")) & (F.col("language") == F.col("ilang")))
    ways = [at(F.col("name")), at(F.try_element_at("aliases", F.col("name"))), at(suffix), at(F.when(F.col("package") != "", F.concat("package", F.lit("."), "name"))), bare]
    return out.unionByName(_best(ways, ["source", "name", "relation"]).select("source", "target", "relation"))


def python_edges(e: DataFrame) -> DataFrame:
    e = e.where("language = 'python'")
    ids, simple = e.select(F.col("fqn").alias("target")), _simple(e)
    each = e.select(F.col("fqn").alias("source"), "refs", F.explode("file_imports").alias("i")).select("source", "refs", F.col("i.module").alias("module"), F.col("i.names").alias("names"))
    named = each.where(F.size("names") > 0).select("source", "refs", "module", F.explode("names").alias("name")).where("size(refs) = 0 or array_contains(refs, name)")
    exact = named.join(ids, F.concat("module", F.lit("."), "name") == F.col("target"))
    by_name = named.join(simple, F.col("name") == F.col("iname"))
    out = _best([exact, by_name], ["source", "module", "name"]).select("source", "target")
    plain = each.where(F.size("names") == 0).where((F.size("refs") == 0) | F.array_contains(F.col("refs"), _leaf("module"))).join(ids, F.col("module") == F.col("target")).select("source", "target")
    sup = e.where("superclass is not null").select(F.col("fqn").alias("source"), "superclass").join(simple, F.col("superclass") == F.col("iname")).select("source", "target")
    return out.unionByName(plain).withColumn("relation", F.lit("import")).unionByName(sup.withColumn("relation", F.lit("extends")))


def _normal(path: Column) -> Column:
    """A path without `.` and `..` parts."""
    return F.array_join(
        F.aggregate(
            F.split(path, "/"), F.array().cast("array<string>"),
            lambda a, p: F.when((p == ".") | (p == ""), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))),
        ), "/",
    )


def typescript_edges(e: DataFrame) -> DataFrame:
    e = e.where("language = 'typescript'")
    module = F.regexp_replace("rel_path", r"\.(?:d\.ts|tsx?|jsx?|mjs|cjs)$", "")
    e = e.withColumn("module", module)
    target = e.where("owner is null").select(F.regexp_replace("module", r"/index$", "").alias("tmodule"), F.col("name").alias("tname"), F.col("fqn").alias("target"))
    each = e.select(F.col("fqn").alias("source"), "refs", "module", F.explode("file_imports").alias("i")).where(F.startswith("i.module", F.lit(".")))
    here = F.regexp_replace("module", r"[^/]*$", "")
    path = F.regexp_replace(F.regexp_replace(_normal(F.concat(here, F.col("i.module"))), r"\.(?:tsx?|jsx?|mjs|cjs)$", ""), r"/index$", "")
    named = each.select("source", "refs", path.alias("tmodule"), F.explode("i.names").alias("tname")).where("array_contains(refs, tname)")
    out = named.join(target, ["tmodule", "tname"]).select("source", "target", F.lit("import").alias("relation"))
    simple = _simple(e)
    parents = e.where("superclass is not null").select(F.col("fqn").alias("source"), F.col("superclass").alias("name"), F.lit("extends").alias("relation"))
    parents = parents.unionByName(e.select(F.col("fqn").alias("source"), F.explode("interfaces").alias("name"), F.lit("implements").alias("relation")))
    return out.unionByName(parents.join(simple, F.col("name") == F.col("iname")).select("source", "target", "relation")).where("source <> target")


def go_edges(e: DataFrame) -> DataFrame:
    e = e.where("language = 'go'")
    # every end of a directory at a slash, so that an import path finds its directory by an equal key
    path = F.regexp_replace("package", r"\.", "/")
    directories = e.select("package", path.alias("dir")).distinct()
    own = e.select("package", "name", F.col("fqn").alias("target")).where("owner is null")
    refs = e.select(F.col("fqn").alias("source"), "package", "file_imports", F.explode("refs").alias("ref"))
    dotted = refs.where("contains(ref, '.')").select("source", F.split("ref", r"\.")[0].alias("q"), F.split("ref", r"\.")[1].alias("name"), F.explode("file_imports").alias("i")).where(F.array_contains("i.names", F.col("q")))
    ends = F.transform(F.sequence(F.lit(1), F.size(F.split("i.module", "/"))), lambda k: F.array_join(F.slice(F.split("i.module", "/"), k, 1000), "/"))
    placed = dotted.select("source", "name", F.explode(ends).alias("dir")).join(directories, "dir")
    far = placed.join(own, ["package", "name"]).select("source", "target")
    near = refs.where("not contains(ref, '.')").join(own, (F.col("ref") == own["name"]) & (refs["package"] == own["package"])).select("source", "target")
    return far.unionByName(near).where("source <> target").withColumn("relation", F.lit("uses"))


def c_edges(e: DataFrame) -> DataFrame:
    e = e.where(F.col("language").isin("c", "cpp"))
    key = F.regexp_replace("rel_path", r"\.[^./]*$", "")
    e = e.withColumn("key", key)
    files = e.groupBy("key").agg(F.max_by("fqn", "seq").alias("target"))  # the last declaration stands for its file
    simple = e.groupBy(F.col("name").alias("iname")).agg(F.max_by("fqn", "entity_seq").alias("target"))
    includes = e.select(F.col("fqn").alias("source"), F.regexp_replace("key", r"[^/]*$", "").alias("here"), F.explode("imports").alias("path")).withColumn("name", F.regexp_replace("path", r"\.[^./]*$", ""))
    local = includes.join(files, _normal(F.concat("here", "name")) == F.col("key"))
    rooted = includes.join(files, F.col("name") == F.col("key"))
    by_stem = includes.join(simple, F.regexp_extract("name", r"([^/]*)$", 1) == F.col("iname"))
    out = _best([local, rooted, by_stem], ["source", "path"]).select("source", "target", F.lit("import").alias("relation"))
    bases = F.array_compact(F.concat(F.array("superclass"), "interfaces"))
    parents = e.select(F.col("fqn").alias("source"), F.explode(bases).alias("name")).join(simple, F.col("name") == F.col("iname")).select("source", "target", F.lit("extends").alias("relation"))
    return out.unionByName(parents).where("source <> target")


RULES = (
    (jvm_edges, {"java", "kotlin"}), (python_edges, {"python"}), (typescript_edges, {"typescript"}), (go_edges, {"go"}), (c_edges, {"c", "cpp"}),
)


def link(facts: DataFrame) -> CodeGraph:
    unique, rows = _entities(facts)
    unique = cut_lineage(unique)
    found = {r[0] for r in unique.select("language").distinct().collect()}
    rules = [f for f, languages in RULES if found & languages]
    none = facts.sparkSession.createDataFrame([], "source string, target string, relation string")
    edges = cut_lineage(reduce(DataFrame.unionByName, [f(unique).select("source", "target", "relation") for f in rules], none).distinct())
    entities = unique.select(
        "fqn", "name", "package", F.col("rel_path").alias("file_path"), "kind", "language", "imports", "superclass", "interfaces", "owner", "is_data", "is_sealed", F.col("aliases").alias("import_aliases"), "entity_seq",
    )
    packages = rows.select("package", "fqn", F.col("seq").alias("pos"))  # overloads stay in the lists
    return CodeGraph(entities, edges.withColumn("edge_seq", F.pmod(F.xxhash64("source", "target", "relation"), F.lit(1 << 40))), packages)
