"""Shared helpers of the training-data operators: scratch tables, Arrow text buffers, hashing."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_PATHS: dict[int, str] = {}
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a session of one machine may leave it unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _OWN.get(spark.sparkContext.applicationId) or _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="inkframe-"))
    return root.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared scratch folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/inkframe-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(found)] = path
    weakref.finalize(found, _PATHS.pop, id(found), None)
    return found


def drop(*stashed: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more: all that was made of them has been written."""
    for df in stashed:
        if (path := _PATHS.pop(id(df), None)) is not None:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows and some 16 MB, so that a batch of very long texts fits a Python worker."""
    if int(spark.conf.get(ARROW_ROWS, "10000")) > rows:
        spark.conf.set(ARROW_ROWS, str(rows))
    spark.conf.set(ARROW_BYTES, str(1 << 24))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column], F.lit(""))


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array end to end, and the offsets of its rows; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) else "")
    width = np.int64 if pa.types.is_large_string(array.type) else np.int32
    offsets = np.frombuffer(array.buffers()[1], dtype=width)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = raw(batch.column(column))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def runs(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of the rows that follow one another with the same ``column``; the input is sorted by it."""
    kept: list[pa.RecordBatch] = []
    key: object = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_pylist()
        at = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[at]:
                continue
            if kept and keys[at] != key:
                yield pa.Table.from_batches(kept)
                kept = []
            key = keys[at]
            kept.append(batch.slice(at, i - at))
            at = i
    if kept:
        yield pa.Table.from_batches(kept)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def arrow_rows(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in schema], schema=schema)


_SQL_TYPES = {pa.int32(): "int", pa.int64(): "bigint", pa.float64(): "double", pa.bool_(): "boolean", pa.string(): "string", pa.binary(): "binary"}


def ddl(schema: pa.Schema) -> str:
    """The schema as Spark writes it."""
    return ", ".join(f"{f.name} {_SQL_TYPES[f.type]}" for f in schema)
