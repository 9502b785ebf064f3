"""Shared plumbing of the corpus operators: Arrow batches of texts, scratch tables, hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import sys
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters (bytes of UTF-8) handed to a kernel at once; one longer text goes alone.
STEP_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id written as text: the fold of a row, whatever its position."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a default only where they are one process anyway."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or "/tmp/checkpoints"


def written(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*stored: DataFrame | None) -> None:
    """Delete tables that written() made; only once what is made from them has been written."""
    for df in stored:
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()} if df is not None else ():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: What workers keep while they go through a partition, and drop at its end.
_kept: list[Callable] = []


def per_partition(make: Callable) -> Callable:
    """Remember what make() returned until the partition ends; then other stages get the memory."""
    held = cache(make)
    _kept.append(held)
    return held


def release() -> None:
    """Drop what per_partition() remembers, and give freed pages back to the system."""
    for held in _kept:
        held.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batch: pa.RecordBatch, text: int, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `step` bytes of text each, one row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64) + 16)
    start = 0
    while start < n:
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + step, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller Arrow batches for jobs that run inside the block; the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def map_texts(
    df: DataFrame,
    kernel: Callable[..., dict[str, Sequence]],
    schema: str,
    columns: Sequence[str] = ("doc_id", "text"),
    step: int = STEP_BYTES,
) -> DataFrame:
    """kernel(*lists of the columns) -> lists by name; the last column is the text.

    Each task streams its Arrow batches in slices bounded by bytes, so memory follows the
    slice and the longest single text, not the partition. Nothing is shuffled.
    """
    fields = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in pieces(batch, len(columns) - 1, step):
                    made = kernel(*(c.to_pylist() for c in part.columns))
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)
        finally:
            release()

    return df.select(*columns).mapInArrow(run, fields)


class Memo(dict):
    """A dict that computes missing values, and keeps the first that fit: the frequent come early.

    Bounded by bytes, and long keys are never kept, so what a worker holds does not depend on the texts.
    """

    LONGEST_KEY = 64

    def __init__(self, compute: Callable, most_bytes: int = 16 << 20, slot: int = 100):
        """slot: bytes of an entry besides key and value, about."""
        super().__init__()
        self.compute, self.room, self.slot = compute, most_bytes, slot

    def __missing__(self, key):
        value = self.compute(key)
        if self.room > 0 and len(key) <= self.LONGEST_KEY:
            self.room -= self.slot + sys.getsizeof(key) + sys.getsizeof(value)
            self[key] = value
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
