"""What every operator of this subpackage shares: shipping, shared storage and bounded batches."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step holds at a time; a longer document is a step of its own.
SLICE_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the executors, whatever their PYTHONPATH is."""
    sc = spark.sparkContext
    if getattr(sc, "_tributary_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.dirname(root)
    fd, path = tempfile.mkstemp(prefix="tributary-", suffix=".zip")
    os.close(fd)
    path = os.path.realpath(path)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(path)
    if path in sys.path:  # the driver keeps its own copy first
        sys.path.remove(path)
        sys.path.append(path)
    atexit.register(lambda: os.path.exists(path) and os.remove(path))
    sc._tributary_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's, or in local mode one of our own where none is set.

    On a cluster without spark.checkpoint.dir this raises, as executors would write to disks that nobody else sees.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = getattr(sc, "_tributary_dir", None)
        if not d:
            own = os.path.realpath(tempfile.mkdtemp(prefix="tributary-checkpoint-"))
            atexit.register(shutil.rmtree, own, True)
            d = sc._tributary_dir = f"file://{own}"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(d)
    return d


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A path of its own in the shared folder, which goes when the driver's JVM ends in order."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(df: DataFrame) -> DataFrame:
    """Writes df into the shared folder and reads it back: lineage ends there, so a lost executor costs no recomputation.

    Files are compressed with zstandard. They go with drop_tables, or when the driver ends.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tributary_path = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Deletes what table() wrote, and lets go of the shuffle files of queries that are done. No query may need them any more."""
    spark = tables[0].sparkSession
    for t in tables:
        remove_path(spark, t._tributary_path)
    release(spark)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished queries: it does so when the driver collects its garbage."""
    gc.collect()
    with contextlib.suppress(Exception):  # a hint only
        spark.sparkContext._jvm.System.gc()


def local(df: DataFrame) -> pd.DataFrame:
    """The rows of a bounded df on the driver. They come by Arrow: row objects would take many times their memory."""
    return df.toArrow().to_pandas()


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: object) -> DataFrame:
    """mapInArrow with the package shipped first. A worker gives free memory back after each task, as it lives on through stages."""
    ship(df.sparkSession)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(lean, schema)


def give_back() -> None:
    """Returns what this process has freed to the operating system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part's texts hold at most so many bytes, or are one document."""
    n = batch.num_rows
    if not n:
        return
    arr = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(byte_lengths(arr))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, base + most, side="right"))
        to = min(n, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to


def byte_lengths(arr: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(arr), 0)).astype(np.int64)


class Texts:
    """The texts of an Arrow column as one byte buffer; a null counts as empty."""

    def __init__(self, arr: pa.Array):
        import pyarrow.compute as pc

        if arr.null_count:
            arr = pc.fill_null(arr, "")
        arr = arr.cast(pa.large_binary())
        self.n = len(arr)
        off = np.frombuffer(arr.buffers()[1], np.int64, count=self.n + 1 + arr.offset)[arr.offset :] if self.n else np.zeros(1, np.int64)
        buf = arr.buffers()[2]
        whole = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
        self.data = whole[off[0] : off[-1]]
        self.offsets = off - off[0]

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def binary_array(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow array over data without a copy; offsets has one entry more than values."""
    return pa.Array.from_buffers(kind or pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... (lengths[i] of them), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out_start = np.cumsum(lengths) - lengths
    return np.repeat(starts - out_start, lengths) + np.arange(total)


def kept(name: str, make: Callable[[], object]) -> object:
    """A value that a Python worker keeps from task to task."""
    box = sys.modules.setdefault("_tributary_kept", type(sys)("_tributary_kept")).__dict__
    if name not in box:
        box[name] = make()
    return box[name]
