"""Incremental parsing as a file stream: each new or changed file is extracted once and upserted by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codestrata.sources.files import cached_facts, source_files
from codestrata.streaming.schema import BINARY_FILE


def follow(spark: SparkSession, path: str, cache: str, checkpoint: str, exclude_tests: bool = True):
    """Start a query that keeps the facts table `cache` up with the files below path and ends when it has caught up.
    Spark's file stream passes over empty files and names that start with an underscore; a batch run reads those."""
    stream = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").load(path)

    def upsert(batch: DataFrame, _: int) -> None:
        files = source_files(batch.sparkSession, path, None, exclude_tests).join(batch.select("path"), "path", "left_semi")
        cached_facts(batch.sparkSession, files, batch, cache)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
