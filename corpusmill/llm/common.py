"""Helpers that several operators share: folders, table sizes, hashing and Arrow buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Workers outlive stages: Arrow's own pools keep what a stage has freed, the system's gives large buffers back.
pa.set_memory_pool(pa.system_memory_pool())

NO_ID = np.iinfo(np.int64).max
U64 = np.uint64


#: Caches that a worker keeps from task to task; each has ``drop``.
CACHES: weakref.WeakSet = weakref.WeakSet()


def release_memory(keep: object = None) -> None:
    """Give back to the system what this worker holds but doesn't use, and drop other operators' caches than ``keep``; workers outlive stages, and would keep the peak of each."""
    for cache in list(CACHES):
        if cache is not keep:
            cache.drop()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def use_shared_folder(spark: SparkSession) -> None:
    """Make ``checkpoint()`` write to the folder named by spark.checkpoint.dir; where that is unset, to a new one in local mode (tests), which has no other machines."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = tempfile.mkdtemp(prefix="corpusmill-")
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared folder and cut its lineage."""
    use_shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_WRITTEN: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; ``remove`` or ``clean_up`` deletes what is written there."""
    use_shared_folder(spark)
    _WRITTEN.append(f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def written() -> set[str]:
    """The folders from ``shared_path`` that are still there."""
    return set(_WRITTEN)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that no frame still in use reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def clean_up(spark: SparkSession) -> None:
    """Delete every folder from ``shared_path``, once no result that reads them is needed any more."""
    for path in list(_WRITTEN):
        remove(spark, path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes in a column, over all rows."""
    return int(df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
        column = column.fill_null(b"" if binary else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ids_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of ids as int64; null counts as larger than any id."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... over lengths[i] for every i, in one array."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return np.repeat(starts.astype(np.int64) - before, lengths) + np.arange(total, dtype=np.int64)


def parts_of(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """The texts in turn, about ``size`` bytes at a time; a longer text is a part of its own."""
    lengths = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, a = np.cumsum(lengths), 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield texts.slice(a, b - a)
        a = b
