"""Helpers shared by the operators: shared work folder, written tables, Arrow mapping, checked joins."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a key table that may be sent to every executor (8-byte keys: some 30 MB as a hash relation).
BROADCAST_ROWS = 500_000

#: Spark's setting that a finished query removes its own shuffle files.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, the folder that driver and executors share.

    Only where that setting is missing and all runs in one process (tests) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="codestrata-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/codestrata-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet into the shared folder and read again: cuts lineage, survives lost executors. Shuffle files of
    the write go with it, as nothing reads them again; else they stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._codestrata_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by `written` that no later step reads."""
    for df in frames:
        delete_path(df.sparkSession, df._codestrata_path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of text whose Python objects exist at a time, one text at least.
SLICE_BYTES = 4 << 20


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in small pieces, so that Python objects of a few rows exist at a time; with `text`, the place of a
    string column, pieces also hold no more than SLICE_BYTES of it, or one row."""
    for batch in batches:
        if text is None:
            sizes = None
        else:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = min(batch.num_rows, at + rows)
            if sizes is not None:
                before = sizes[at - 1] if at else 0
                end = min(end, max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right"))))
            yield batch.slice(at, end - at)
            at = end


def map_rows(df: DataFrame, start: Callable[[], Callable], schema: str, rows: int = 512) -> DataFrame:
    """mapInArrow in small pieces, bounded by their bytes where there is a column text or html. `start` runs once per task and returns a function from one list per
    input column to one list per output column."""
    names = [part.strip().split()[0] for part in schema.split(",")]
    text = next((df.columns.index(c) for c in ("text", "html") if c in df.columns), None)

    def run(batches):
        step = start()
        kind = None
        for piece in slices(batches, rows, text):
            columns = step(*[column.to_pylist() for column in piece.columns])
            if kind is None:
                kind = arrow_types(schema)
            yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(columns, kind)], names=names)

    return df.mapInArrow(run, schema)


_KEPT: dict = {}


def per_worker(key, build: Callable):
    """What a Python worker keeps between tasks: one thing at a time, as workers serve many operators one after another."""
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        hand_back()
        _KEPT[key] = build()
    return _KEPT[key]


def hand_back() -> None:
    """Give freed memory back to the system: what a worker has freed still counts against its executor."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow_types(schema: str) -> list[pa.DataType]:
    """Arrow types of a schema string that uses the few type names below."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
        "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    }
    return [kinds[part.strip().split()[1]] for part in schema.split(",")]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The key table with a broadcast hint if it has no more than `rows` rows; beyond, the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
