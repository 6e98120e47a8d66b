"""Cutting the lineage of iterative plans at the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """The frame, checkpointed below spark.checkpoint.dir; a temporary folder is set only where that is unset and all runs in one process."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="codestrata-"))
    return df.checkpoint()


def maybe_broadcast(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A broadcast hint only for a table of no more than `rows` rows; beyond, the join shuffles."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sized(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """The side of a join that is broadcast up to `rows` rows; beyond, both sides shuffle. Left to itself, Spark takes columns that are
    computed from a small file for small, and sends millions of rows through the driver."""
    out = maybe_broadcast(df, rows)
    return out if out is not df else df.hint("merge")
