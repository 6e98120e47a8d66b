"""One thin query for each operator, over its whole table, with the parameters of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codestrata.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from codestrata.llm.toxicity import held_out, scored, train

    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from codestrata.llm.token_output import token_files

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from codestrata.llm.line_dedup import deduplicated

    out = deduplicated(table(spark, sf_dir, "documents"), min_sites=8)
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op4_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from codestrata.llm.ball_tree import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codestrata.llm.ngram_join import components

    return components(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codestrata.llm.pii import found_spans

    return found_spans(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codestrata.llm.mixing import mix_plan

    plan = mix_plan(table(spark, sf_dir, "documents"), ["doc_id"], weights=(3.0, 1.0, 2.0), share=1.5, max_repeat=2)
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codestrata.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codestrata.llm.html_extract import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents have no paths, so each gets one from its source and id: a directory tree of two levels below the
    source, in which every twentieth document is the licence file of an upper directory."""
    from pyspark.sql import functions as F

    from codestrata.llm.licenses import scan

    upper = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.lit("d"), F.floor(F.col("doc_id") / 1000)))
    lower = F.concat(F.lit("d"), F.floor(F.col("doc_id") / 100))
    path = F.when(F.col("doc_id") % 20 == 0, F.concat_ws("/", upper, F.concat(F.lit("LICENSE."), "doc_id"))).otherwise(F.concat_ws("/", upper, lower, F.concat("doc_id", F.lit(".txt"))))
    return scan(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": _OP3, "op4_ball_tree": _OP4, "op5_ngram_join": _OP5}


_OP5 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(na.n) + any_value(nb.n) - count(*))
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""


_OP3 = """
WITH lines AS (
  SELECT doc_id, i, line, coalesce('=' || source, '') AS site
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM documents WHERE text <> '')
), gone AS (
  SELECT trim(line, ' ') AS line FROM lines WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT site) >= 8
), kept AS (
  SELECT l.doc_id, count(*) AS n, count(g.line) AS removed,
    coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (g.line IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON trim(l.line, ' ') = g.line GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(k.n, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.removed, 0) AS INTEGER) AS n_removed,
  md5(coalesce(k.text, d.text)) AS text_md5
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


_OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""
