"""Discovery of source files, extraction on executors, and the cache of facts."""

from __future__ import annotations

import datetime
import os
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions.storage import cut_lineage
from codestrata.model import CodeGraph
from codestrata.operators.merge import merge
from codestrata.schemas import FACTS
from codestrata.sources.extract import EXTENSIONS, LANGUAGE_OF, extract
from codestrata.sources.link import link

# Where sources stand, tried in order, and directories that are passed over.
PREFERRED_ROOT = {"java": "src/main/java", "kotlin": "src/main/kotlin"}
SOURCE_ROOTS = ("src/main/java", "src/main/kotlin", "src/main/scala", "src/main", "src", "lib", "app")
EXCLUDED = ("test tests node_modules vendor third_party third-party thirdparty external ext-tools build dist target .git .svn __pycache__ .venv venv env").split()
EXCLUDED_STARTS = ("src/test", "src/tests")


def not_excluded(rel_path: Column) -> Column:
    """No directory of the path below the project root is in the excluded set."""
    parts = F.split(rel_path, "/")
    inside = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(*EXCLUDED))
    return ~(inside | reduce(lambda a, b: a | b, [F.startswith(rel_path, F.lit(s + "/")) for s in EXCLUDED_STARTS]))


def source_root(path: str, language: str | None = None) -> str:
    """The language's own root, else the first well-known directory that exists, else the project itself."""
    tries = [PREFERRED_ROOT[language]] if language in PREFERRED_ROOT else []
    return next((f"{path}/{r}" for r in [*tries, *SOURCE_ROOTS] if os.path.isdir(f"{path}/{r}")), path)


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of all files below a directory. Spark's file sources pass over names that
    start with an underscore, such as __init__.py; those, few as they are, are read by the driver."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length", "content")
    rows = []
    top = path.removeprefix("file://")
    for folder, _, names in os.walk(top):
        for name in names:
            full = f"{folder}/{name}"
            if os.path.splitext(name)[1] in LANGUAGE_OF and any(part.startswith("_") for part in os.path.relpath(full, top).split("/")):
                with open(full, "rb") as f:
                    rows.append(("file:" + full, datetime.datetime.fromtimestamp(os.path.getmtime(full), datetime.timezone.utc), os.path.getsize(full), f.read()))
    return found.unionByName(spark.createDataFrame(rows, found.schema)) if rows else found


def source_files(spark: SparkSession, path: str, languages: Iterable[str] | None = None, exclude_tests: bool = True, root: str | None = None) -> DataFrame:
    """(path, rel_path, ext, language, length, modified) of the files of known languages; contents are not read."""
    found = read_contents(spark, path).select("path", "length", F.col("modificationTime").alias("modified"))
    clean = F.regexp_replace("path", r"^file:/*", "/")
    top = (root or path).rstrip("/") + "/"
    ext = F.concat(F.lit("."), F.regexp_extract(clean, r"\.([^./]+)$", 1))
    language = F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair]), ext)
    out = found.select("path", F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {len(top) + 1})").alias("rel_path"), ext.alias("ext"), language.alias("language"), "length", "modified").where("language is not null")
    if exclude_tests:
        out = out.where(not_excluded(F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {len(path.rstrip('/')) + 2})")))
    return out if languages is None else out.where(F.col("language").isin(*languages))


def dominant_language(files: DataFrame) -> str | None:
    """The language of the most frequent suffix."""
    row = files.groupBy("ext", "language").agg(F.count("*").alias("n"), F.min("path").alias("first")).orderBy(F.desc("n"), "first").first()
    return row["language"] if row else None


def all_languages(files: DataFrame) -> list[str]:
    """S8."""
    return sorted(r[0] for r in files.select("language").distinct().collect())


def resolve_languages(language: str | None, languages: list[str] | None, found: list[str]) -> list[str]:
    """One argument or the other; `multi` and nothing mean what is found."""
    if language and languages is not None:
        raise ValueError("give language or languages, not both")
    if languages is not None and not languages:
        raise ValueError("languages is empty")
    asked = languages if languages is not None else [language] if language and language != "multi" else found
    if unknown := [x for x in asked if x not in EXTENSIONS]:
        raise ValueError(f"unknown language: {', '.join(unknown)}; known: {', '.join(sorted(EXTENSIONS))}")
    if not asked:
        raise ValueError("no source files of a known language")
    return sorted(set(asked))


def ingest(spark: SparkSession, source: str, language: str | None = None, languages: list[str] | None = None, exclude_tests: bool = True) -> DataFrame:
    """The files of a directory. One language alone narrows to its source root if tests are excluded.
    Fetching repositories over a network is not offered; give a directory."""
    if "://" in source and not source.startswith("file://"):
        raise ValueError("only directories can be read; clone the repository first")
    path = source.removeprefix("file://").rstrip("/")
    asked = resolve_languages(language, languages, all_languages(source_files(spark, path, None, exclude_tests)))
    root = source_root(path, asked[0]) if len(asked) == 1 and exclude_tests else path
    return source_files(spark, root, asked, exclude_tests, root)


def facts_of(files: DataFrame, contents: DataFrame) -> DataFrame:
    """Pass 1 on executors: FACTS of files, with `content` from the binaryFile source."""
    rows = contents.select("path", "content").join(files.select("path", "rel_path", "language"), "path")

    def run(batches):
        for pdf in batches:
            out = []
            for rel_path, language, content in zip(pdf.rel_path, pdf.language, pdf.content):
                f = extract(language, rel_path, bytes(content).decode("utf-8", "replace"))
                entities = [vars(e) for e in f.entities]
                out.append((rel_path, f.language or language, f.package, entities, [{"module": m, "names": n} for m, n in f.imports], f.aliases, f.error))
            yield pd.DataFrame(out, columns=FACTS.names)

    return rows.mapInPandas(run, FACTS)


def parse(spark: SparkSession, path: str, language: str | None = None, languages: list[str] | None = None, exclude_tests: bool = True, cache: str | None = None) -> CodeGraph:
    """Files to a graph; several languages are parsed apart, merged and linked. With `cache`, a table folder, only
    files whose path and content are new are extracted."""
    files = source_files(spark, path, None, exclude_tests)
    asked = resolve_languages(language, languages, all_languages(files))
    files = files.where(F.col("language").isin(*asked))
    contents = read_contents(spark, path)
    facts = facts_of(files, contents) if cache is None else cached_facts(spark, files, contents, cache)
    facts = cut_lineage(facts)  # read by every linking rule
    if len(asked) == 1:
        return link(facts)
    group = lambda g: facts.where(F.col("language").isin("c", "cpp") if g == "c" else F.col("language") == g)
    return merge([link(group(g)) for g in asked])


def content_key(rel_path: Column, content: Column) -> Column:
    """SHA-256 of path, NUL and content."""
    return F.sha2(F.concat(F.encode(rel_path, "UTF-8"), F.unhex(F.lit("00")), content), 256)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def cached_facts(spark: SparkSession, files: DataFrame, contents: DataFrame, cache: str) -> DataFrame:
    """Facts from the table `cache`; new ones are extracted and appended, whatever is read of it is a hit."""
    keyed = contents.select("path", "content").join(files.select("path", "rel_path"), "path").select("path", "rel_path", content_key(F.col("rel_path"), F.col("content")).alias("key"))
    # only a missing table makes every file a miss; one that cannot be read is an error, not a reason to write over it
    known = spark.read.schema(spark.createDataFrame([], FACTS).withColumn("key", F.lit("")).schema).parquet(cache) if exists(spark, cache) else None
    missing = keyed if known is None else keyed.join(known.select("key"), "key", "left_anti")
    new = facts_of(files.join(missing.select("path"), "path", "left_semi"), contents).join(missing.select("rel_path", "key"), "rel_path")
    new.write.mode("append" if known is not None else "overwrite").parquet(cache)
    known = spark.read.schema(new.schema).parquet(cache)
    one = F.row_number().over(Window.partitionBy("key").orderBy("rel_path"))
    return known.join(keyed.select("key"), "key", "left_semi").withColumn("_r", one).where("_r = 1").select(*FACTS.names)


def cache_key(files: DataFrame, root: str, languages: list[str]) -> str:
    """SHA-256 over root, languages, and the sorted paths with their times; one row reaches the driver."""
    each = F.concat_ws("|", "path", F.col("modified").cast("double").cast("string"))
    return files.agg(F.sha2(F.concat_ws("\n", F.lit(root), F.lit(",".join(languages)), F.array_join(F.array_sort(F.collect_list(each)), "\n")), 256)).first()[0]
