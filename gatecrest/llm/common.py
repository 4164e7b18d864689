"""What the operators share: lineage cuts in the shared folder, size-checked broadcasts, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast up to this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 48 << 20
#: Bytes of an Arrow batch of texts; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``; a folder of our own only where that is unset and there is but one machine."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gatecrest-checkpoint-"))
    return shared or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint that every executor can read again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Lower the bytes of text that go to Python at once to BATCH_BYTES. Documents of many kilobytes make the default of 10,000 rows, or 64 MB, much of an executor's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Hands freed memory back to the system at the end of a task: idle workers would keep it beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such allocator here
        pass


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast only where ``rows * row_bytes`` is within BROADCAST_BYTES."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string or binary array; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return off - off[0], data


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay within ``limit``; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def list_array(flat: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, kind))


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """Each row of a 2-d array as one binary value."""
    width = matrix.shape[1] * matrix.itemsize
    off = (np.arange(len(matrix) + 1) * width).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(matrix).tobytes())])
