"""Shared plumbing: tables staged in the cluster's checkpoint folder, and Arrow column access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is set only where the session names none and runs on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(where)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Rows that Spark sends to Python at a time, at most; texts vary much in length, so few rows bound the memory of a batch.
BATCH_ROWS = 2000
#: Bytes of text that the operators work on at a time; a longer text is a piece of work of its own.
CHUNK_BYTES = 1 << 20


def give_back() -> None:
    """Returns freed memory to the system: allocators keep it, and Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with memory given back after the work on each."""
    for batch in batches:
        yield batch
        del batch
        give_back()


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


class Stages:
    """Intermediate tables written to the shared folder, so that a lost executor costs no recomputation of earlier steps."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        small_batches(spark)
        self._held: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._held.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes staged tables that no later step reads."""
        self._delete([p for df, p in self._held if any(df is f for f in frames)])

    def clear(self, *keep: DataFrame) -> None:
        """Deletes all staged tables but keep."""
        self._delete([p for df, p in self._held if not any(df is f for f in keep)])

    def _delete(self, paths: list[str]) -> None:
        jvm = self.spark._jvm  # noqa: SLF001
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001
        self._held = [(df, p) for df, p in self._held if p not in paths]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int):
    """Ranges of rows with about limit bytes each; a longer row is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
