"""Code graphs derived from the order tables: parts (GP, GPS), nations (GN), trade (GT) and a small polyglot set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions.storage import sized
from codestrata.model import Architecture, CodeGraph, architecture_by


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    words = F.split("p_name", " ")
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))
    name = F.concat(F.array_join(F.transform(words, capital), ""), F.col("p_partkey"))
    package = F.concat(F.lit("shop."), F.lower("p_type"), F.lit("."), F.lower(F.regexp_replace("p_brand", "#", "")))
    out = part.select(
        F.concat(package, F.lit("."), name).alias("fqn"),
        name.alias("name"),
        package.alias("package"),
        F.concat(F.lit("src/"), F.regexp_replace(package, r"\.", "/"), F.lit("/"), capital(words[1]), F.lit(".java")).alias("file_path"),
        F.element_at(F.array(*map(F.lit, ("class", "interface", "enum", "method"))), (F.col("p_size") % 4 + 1).cast("int")).alias("kind"),
        F.element_at(F.array(*map(F.lit, ("java", "kotlin", "python"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("language"),
        F.col("p_partkey").alias("entity_seq"),
        "p_partkey", "p_type", "p_brand", "p_size",
    )
    lead = F.min_by(F.when(F.col("kind") != "method", F.col("fqn")), F.when(F.col("kind") != "method", F.col("entity_seq"))).over(Window.partitionBy("package"))
    return out.withColumn("owner", F.when(F.col("kind") == "method", lead))


def part_graph(spark: SparkSession, sf_dir: str, min_quantity: int | None = None) -> CodeGraph:
    """GP: parts, with an edge for neighbouring lines of an order. GPS, for tests on a sparse graph: edges from lines of min_quantity or more;
    registered queries leave it unset."""
    entities = part_entities(spark, sf_dir)
    rows = read(spark, sf_dir, "lineitem")
    line = (rows if min_quantity is None else rows.where(F.col("l_quantity") >= min_quantity)).select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    b = rows.select("l_orderkey", F.col("l_partkey").alias("b_part"), (F.col("l_linenumber") - 1).alias("l_linenumber"))
    relation = F.when(F.col("l_returnflag") == "A", "import").when(F.col("l_returnflag") == "N", "extends").otherwise("implements")
    pairs = line.join(b, ["l_orderkey", "l_linenumber"]).where("l_partkey <> b_part").select("l_partkey", "b_part", relation.alias("relation")).repartition("l_partkey").distinct()  # one shuffle for both that and the next join
    names = sized(entities.select("p_partkey", "fqn"))
    edges = (
        pairs.join(names.withColumnsRenamed({"p_partkey": "l_partkey", "fqn": "source"}), "l_partkey")
        .join(names.withColumnsRenamed({"p_partkey": "b_part", "fqn": "target"}), "b_part")
        # the order of (source part, target part, relation) as a number, without a global sort
        .select("source", "target", "relation", (F.col("l_partkey") * (1 << 33) + F.col("b_part") * 4 + F.when(F.col("relation") == "extends", 0).when(F.col("relation") == "implements", 1).otherwise(2)).alias("edge_seq"))
    )
    return CodeGraph(entities, edges)


def by_type(graph: CodeGraph) -> Architecture:
    return architecture_by(graph, F.col("p_type"))


def by_brand(graph: CodeGraph) -> Architecture:
    return architecture_by(graph, F.col("p_brand"))


def by_package(graph: CodeGraph) -> Architecture:
    return architecture_by(graph, F.col("package"))


def nation_graph(spark: SparkSession, sf_dir: str, top: int) -> tuple[CodeGraph, Architecture]:
    """GN: nations, each with its `top` heaviest foreign supplier nations, and its regions as components."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    entities = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_name").alias("fqn"), F.col("n_name").alias("name"), F.col("r_name").alias("package"), F.concat("r_name", F.lit("/"), "n_name").alias("file_path"),
        F.lit("class").alias("kind"), F.lit("java").alias("language"), F.lit(None).cast("string").alias("owner"), F.col("n_nationkey").cast("long").alias("entity_seq"),
    )
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("cn"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("sn"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    weight = line.join(s, "l_suppkey").join(o, "l_orderkey").join(c, "o_custkey").where("cn <> sn").groupBy("cn", "sn").agg(F.sum("l_quantity").alias("q"))
    rank = F.row_number().over(Window.partitionBy("cn").orderBy(F.desc("q"), "sn"))
    heavy = weight.withColumn("r", rank).where(F.col("r") <= top)
    names = nation.select("n_nationkey", "n_name")
    edges = (
        heavy.join(names.select(F.col("n_nationkey").alias("cn"), F.col("n_name").alias("source")), "cn")
        .join(names.select(F.col("n_nationkey").alias("sn"), F.col("n_name").alias("target")), "sn")
        .select("source", "target", F.lit("uses").alias("relation"), (F.col("cn") * 100 + F.col("sn")).cast("long").alias("edge_seq"))
    )
    graph = CodeGraph(entities, edges)
    return graph, architecture_by(graph, F.col("package"))


def trade_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """GT: customers depend on suppliers they bought from."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("fqn"), F.col("n_name").alias("package"), F.col("c_custkey").alias("entity_seq"))
    s = read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("fqn"), F.col("n_name").alias("package"), (F.col("s_suppkey") + F.lit(1 << 40)).alias("entity_seq"))
    entities = c.unionByName(s).select("fqn", F.col("fqn").alias("name"), "package", F.col("package").alias("file_path"), F.lit("class").alias("kind"), F.lit("java").alias("language"), F.lit(None).cast("string").alias("owner"), "entity_seq")
    pairs = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    names_c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("source"))
    names_s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("target"))
    edges = pairs.join(names_c, "o_custkey").join(names_s, "l_suppkey").select("source", "target", F.lit("uses").alias("relation"), F.xxhash64("source", "target").alias("edge_seq"))
    return CodeGraph(entities, edges)


#: (order of the graph, fqn, name, package, language) and edges, for merging and linking across languages.
POLYGLOT_ENTITIES = [
    (0, "app.core.Base", "Base", "app.core", "java", ["java.util.List"], None, []),
    (0, "app.core.Api", "Api", "app.core", "java", [], None, []),
    (0, "app.util", "util", "app", "java", [], None, []),
    (1, "app.core.Base", "Base", "app.core", "kotlin", [], None, []),
    (1, "app.ui.Screen", "Screen", "app.ui", "kotlin", ["app.core.Base"], "Base", ["Api"]),
    (2, "app.util", "util", "app", "python", [], None, []),
    (2, "app.tool.Base", "Base", "app.tool", "python", ["app.core.Api"], "Base", []),
]
POLYGLOT_EDGES = [(0, "app.core.Api", "app.core.Base", "extends"), (1, "app.ui.Screen", "app.core.Base", "import"), (2, "app.tool.Base", "app.util", "import")]
