"""The corpus pipeline: documents in, token files out, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next one. All but the last return the columns of documents. What each decides takes effect: it passes on
the documents that it keeps, unchanged, and the mix repeats documents as its targets ask.

Defined cases of every stage: an empty table gives an empty one; nulls may stand in any column; further columns, whatever their
names, are passed on by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codestrata.llm.common import discard, table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores 0.5 or more go. It is fitted to the labelled documents of the
    stage's own input; without labels of both classes all stay. Null and empty texts score as the bias does; repeated rows go or stay
    alike."""
    from codestrata.llm.toxicity import kept_documents, train

    return kept_documents(docs, train(docs, table(spark, sf_dir, "labels")), threshold=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose sets of five-word shingles are similar by 0.8 or more, the one with the
    smallest doc_id stays. Null and empty texts have no copies and stay; rows that repeat a doc_id and its text become one, rows without
    a doc_id stay."""
    from codestrata.llm.ngram_join import one_of_each

    return one_of_each(docs, words=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go. Null and empty texts, and items without words, match nothing."""
    from codestrata.llm.decontaminate import clean_documents

    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix takes it. A document without words is in no mix, so it goes; a null source is a source of
    its own; rows that repeat a doc_id and its text are taken alike."""
    from codestrata.llm.mixing import mixed

    return mixed(docs, weights=(3.0, 1.0, 2.0), share=1.5, max_repeat=2)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: one row per document, repeated ones each."""
    import public_tokenizers

    from codestrata.llm.token_output import token_files

    return token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: SQL can express neither the fitted machine nor byte-level BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
