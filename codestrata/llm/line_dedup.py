"""Removal of lines that spread over many sites.

Every line is read once, as one light row: document, position, 64-bit hash of the line without outer spaces, hash of the site. Lines seen
at least `min_sites` times on more than one site (others cannot be on as many sites) get a HyperLogLog sketch of their sites;
sketches merge by aggregation. A line whose estimate is within the sketch's error of the threshold gets its exact number of distinct
sites; the others are decided by the estimate. An equi-join on the hash finds where the lines on at least min_sites sites stand, and each
document that has some gets their positions; its text is cut there. All of it is DataFrame functions; tables of keys go to
every executor only while they are small, beyond that the joins shuffle.

Defined cases: a null text stays null and an empty one stays empty, both with no line removed; lines of spaces only are
never removed; a null source is a site of its own; repeated rows count as often as they stand and are cut alike; a document that loses
every line becomes the empty text; further columns are kept, and where one is called n_lines or n_removed the new one is called
n_lines_ or n_removed_ instead; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import discard, small, written

#: log2 of a sketch's registers, and its error at three standard deviations: 3 * 1.04 / sqrt(2**LG_K).
LG_K = 10
MARGIN = 3 * 1.04 / (1 << LG_K) ** 0.5


def _split() -> Column:
    return F.split("text", "\n", -1)


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text, which with doc_id stands for a document), at (position from 0), h (line), site."""
    site = F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    line = F.posexplode(F.transform(_split(), lambda x: F.trim(x))).alias("at", "line")
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), site.alias("site"), line).where("line <> ''")
    return rows.select("doc_id", "t", "at", F.xxhash64("line").alias("h"), "site")


def spread_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """h: hashes of the lines that stand on at least min_sites sites."""
    often = lines.groupBy("h").agg(F.count("*").alias("n"), F.min("site").alias("a"), F.max("site").alias("b"))
    often = written(often.where((F.col("n") >= min_sites) & ((F.col("a") != F.col("b")) | F.lit(min_sites <= 1))).select("h"), "often")
    sketched = lines.join(small(often), "h").groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    sketched = written(sketched.select("h", F.hll_sketch_estimate("sketch").alias("sites")), "spread")
    near = F.col("sites").between(min_sites * (1 - MARGIN) - 1, min_sites * (1 + MARGIN) + 1)
    exact = lines.join(small(sketched.where(near).select("h")), "h").groupBy("h").agg(F.count_distinct("site").alias("sites"))
    out = written(sketched.where(~near).unionByName(exact).where(F.col("sites") >= min_sites).select("h"), "gone")
    discard(often, sketched)
    return out


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def without_lines(docs: DataFrame, lines: DataFrame, gone: DataFrame) -> DataFrame:
    """docs with text rid of the lines in gone, and n_lines, n_removed."""
    cut = lines.join(small(gone), "h", "left_semi").groupBy("doc_id", "t").agg(F.collect_set("at").alias("at"))
    cut = written(cut.select(F.col("doc_id").alias("_doc"), F.col("t").alias("_t"), F.col("at").alias("_at")), "cut")
    row = docs.select(F.struct("*").alias("_row"), "doc_id", "text", F.xxhash64("text").alias("_hash"))
    joined = row.join(small(cut), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_t")), "left")
    n = F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.size(_split()))
    kept = F.array_except(F.sequence(F.lit(0), F.size(_split()) - 1), F.col("_at"))
    text = F.when(F.col("_at").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda k: F.element_at(_split(), k + 1)), "\n"))
    columns = [text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return joined.select(*columns, n.alias(_free("n_lines", docs.columns)), F.coalesce(F.size("_at"), F.lit(0)).alias(_free("n_removed", docs.columns)))


def deduplicated(docs: DataFrame, min_sites: int = 8) -> DataFrame:
    lines = written(line_rows(docs), "lines")
    out = without_lines(docs, lines, spread_lines(lines, min_sites))
    discard(lines)  # what is left of it is in tables of its own
    return out
