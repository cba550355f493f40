"""Helpers that the operators share: the shared folder, Arrow batches, column picking."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker holds at once when it works batch by batch.
BATCH_BYTES = 1 << 20
#: Rows of whole texts that come to a Python worker at once.
BATCH_ROWS = 1000
#: Schemes that Spark's file systems have and Arrow's know by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is unset and the master is local (tests on one machine) a local folder is made and set;
    on a cluster without the setting each executor would write to its own disk, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="bitquarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved_paths(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``saved``, and the folder, to be given to ``discard`` once nothing reads it any more."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table from which all that is needed has been written elsewhere."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries now: it does so once the driver has collected its garbage.

    The files of the query that ended last may stay, for its end is told to listeners meanwhile: call this some queries later.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, by Spark's schemes, and the path within it."""
    scheme, colon, rest = uri.partition("://")
    if not colon:
        scheme, rest = "file", uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def write_file(uri: str, data: bytes) -> None:
    """Write a whole file; readers never see half of one, for the name is given last."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, path)


def read_file(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it where the table has such a column, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit("")).alias("text")


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``most`` bytes in ``column``; a longer value comes alone."""
    for b in batches:
        at, n = 0, b.num_rows
        if n == 0:
            continue
        sizes = pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        total = 0
        for i in range(n):
            if total and total + sizes[i] > most:
                yield b.slice(at, i - at)
                at, total = i, 0
            total += int(sizes[i])
        yield b.slice(at)


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in Arrow batches of at most BATCH_ROWS rows, unless the session says otherwise.

    Spark's own default of 10,000 rows is hundreds of megabytes of long texts, in the executor and in its worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same generator, after which the worker gives freed memory back: idle workers stay beside others' tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            getattr(ctypes.CDLL(None), "malloc_trim", int)(0)

    return tidied


def flat_bytes(column: pa.Array):
    """The UTF-8 bytes of a string or binary column without nulls as one array, and the row offsets in it."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]
