"""The same operators over streams of files: chat records, exact dedup, and packing in the order of rows with a carried-over tail."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusmill.functions.text import clean_rows
from corpusmill.operators.chat import MESSAGES, for_storage, storage_error


def chat_feed(spark: SparkSession, path: str, include_think: bool = False, extra: str = "", files_a_batch: int | None = None) -> DataFrame:
    """Storable conversations of JSONL files as they arrive, with the fields of ``extra`` (a schema), at most so many files at a time."""
    reader = spark.readStream.schema(f"{extra}, messages {MESSAGES}" if extra else f"messages {MESSAGES}")
    records = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).json(path)
    ready = records.withColumn("messages", for_storage(F.col("messages"), include_think))
    return ready.where(storage_error(F.col("messages")).isNull())


def clean_feed(texts: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """A stream (text, source, ts) cleaned, gated and without texts seen within the watermark."""
    cleaned = clean_rows(texts).where("reason is null").drop("reason")
    hashed = cleaned.withColumn("_h", F.sha2("text", 256)).withWatermark("ts", watermark)
    return hashed.dropDuplicatesWithinWatermark(["_h"]).drop("_h")


_MOST, _PIECE = 1 << 22, 1 << 18
_WINDOW = "shard long, window long, token_ids array<int>"


def _ids(tokens) -> np.ndarray:
    return np.frombuffer(tokens.encode("utf-32-le"), np.int32) if isinstance(tokens, str) else np.asarray(tokens if tokens is not None else [], np.int32)


def _squeezed(ids: np.ndarray) -> bytes:
    """Ids compressed by planes of bytes, of which the upper ones are nearly empty for most texts."""
    return pa.Codec("zstd", 3).compress(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T), asbytes=True)


def _unsqueezed(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * count, "zstd", asbytes=True), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.int32)


class _Packer(StatefulProcessor):
    """A shard's rows in the order of their numbers, however files arrive: rows ahead of the next number wait in the state, and so does the tail of an unfinished window.

    Rows wait in pieces of about ``_PIECE`` ids, sorted by their numbers, since each access to the
    state costs about as much as moving a piece. A piece is read when its first row's turn comes
    and goes when its last row's is over. Windows leave by about ``_MOST`` ids.
    """

    def __init__(self, block: int, count: int, patience: float | None) -> None:
        self.block, self.count, self.patience = block, count, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, window long, tail binary, timer long, pieces binary")
        self.waiting = handle.getMapState("waiting", "piece long", "rows binary, sizes binary, ids binary")

    def _wait(self, rows: list[int], lists: list[np.ndarray]) -> None:
        """Rows in order, to the state."""
        sizes = np.array([len(x) for x in lists], np.int64)
        part = np.cumsum(sizes) // _PIECE
        for k in np.unique(part).tolist():
            a, b = np.searchsorted(part, [k, k + 1]).tolist()
            number = int(self.pieces[:, 0].max(initial=-1)) + 1
            self.waiting.updateValue((number,), (np.array(rows[a:b], np.int64).tobytes(), sizes[a:b].tobytes(), _squeezed(np.concatenate(lists[a:b]))))
            self.pieces = np.vstack((self.pieces, [[number, rows[a], rows[b - 1]]]))

    def _piece(self, number: int) -> dict[int, np.ndarray]:
        rows, sizes, ids = self.waiting.getValue((int(number),))
        ends = np.cumsum(np.frombuffer(sizes, np.int64))
        return dict(zip(np.frombuffer(rows, np.int64).tolist(), np.split(_unsqueezed(ids, int(ends[-1])), ends[:-1]), strict=True))

    def _drain(self, key: tuple) -> Iterator[pd.DataFrame]:
        """Rows whose turn has come, from the pieces that may hold them."""
        order = self.pieces[np.argsort(self.pieces[:, 1], kind="stable")]
        ready, taken = {}, 0
        while True:
            while taken < len(order) and order[taken, 1] <= self.at:
                if order[taken, 2] >= self.at:
                    ready |= {r: x for r, x in self._piece(order[taken, 0]).items() if r >= self.at}
                taken += 1
            if self.at not in ready:
                break
            yield from self._take(key, ready.pop(self.at))
        for number in self.pieces[self.pieces[:, 2] < self.at, 0].tolist():
            self.waiting.removeKey((number,))
        self.pieces = self.pieces[self.pieces[:, 2] >= self.at]

    def _windows(self, key: tuple) -> Iterator[pd.DataFrame]:
        """The whole windows of what came in turn, which leaves their tail."""
        stream = np.concatenate([self.tail, *self.parts])
        n = max(0, (len(stream) - 1) // self.block)
        self.tail, self.parts, self.size = stream[n * self.block :], [], 0
        if n:
            rows = [(int(key[0]), self.window + k, stream[k * self.block : (k + 1) * self.block + 1]) for k in range(n)]
            self.window += n
            yield pd.DataFrame(rows, columns=["shard", "window", "token_ids"])

    def _take(self, key: tuple, ids: np.ndarray) -> Iterator[pd.DataFrame]:
        self.parts.append(ids)
        self.size += len(ids)
        self.at += self.count
        if self.size >= _MOST:
            yield from self._windows(key)

    def _packed(self, key: tuple, frames: Iterator[pd.DataFrame], now: int | None, skip: bool = False) -> Iterator[pd.DataFrame]:
        at, window, tail, timer, pieces = self.place.get() if self.place.exists() else (int(key[0]), 0, b"", None, b"")
        self.at, self.window, self.tail, self.parts, self.size = int(at), int(window), np.frombuffer(tail, np.int32), [], 0
        self.pieces = np.frombuffer(pieces, np.int64).reshape(-1, 3)
        if skip and len(self.pieces):  # the rows before these are given up
            late = self.pieces[self.pieces[:, 1] < self.at, 0].tolist()
            self.at = min([*self.pieces[self.pieces[:, 1] >= self.at, 1].tolist(), *(r for p in late for r in self._piece(p) if r >= self.at)])
        for frame in frames:
            frame = frame.sort_values("row_idx", kind="stable").drop_duplicates("row_idx", keep="last")
            rows, lists = [], []
            for row, t in zip(frame["row_idx"].tolist(), frame["tokens"], strict=True):
                ids = _ids(t)
                if row == self.at:
                    yield from self._take(key, ids)
                elif row > self.at:  # rows that were given up, or came before, are dropped
                    rows.append(row)
                    lists.append(ids)
            if rows:
                self._wait(rows, lists)
        yield from self._drain(key)
        yield from self._windows(key)
        if self.patience is not None and now is not None:
            if timer:
                self.handle.deleteTimer(int(timer))
            timer = now + int(1000 * self.patience) if len(self.pieces) else None
            if timer:
                self.handle.registerTimer(timer)
        self.place.update((self.at, self.window, self.tail.tobytes(), timer, self.pieces.tobytes()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._packed(key, rows, timerValues.getCurrentProcessingTimeInMs() if self.patience is not None else None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._packed(key, iter(()), timerValues.getCurrentProcessingTimeInMs(), skip=True)

    def close(self) -> None:
        pass


def pack_feed(tokens: DataFrame, block: int, count: int = 1, patience: float | None = None) -> DataFrame:
    """A stream (row_idx, tokens array<int>, or string for its characters' code points) cut into windows of block + 1 ids, one token apart from the next by ``block``: shard, window, token_ids.

    Row r, numbered from 0 without gaps over all files, is of shard r % count, and each shard is
    a stream of its own in the order of its rows. Rows may arrive in any order: those ahead of
    the next one wait. With ``patience`` (seconds) a shard that waits longer for a row goes on
    without it, and the row is dropped if it comes later. Null and empty tokens add nothing.
    Strings take a fraction of the disk of arrays where they are shuffled and sorted.
    The state needs a store that can hold maps (``state_store``).
    """
    mode = "None" if patience is None else "ProcessingTime"
    keyed = tokens.select(F.pmod("row_idx", F.lit(count)).cast("long").alias("shard"), "row_idx", "tokens")
    return keyed.groupBy("shard").transformWithStateInPandas(_Packer(block, count, patience), _WINDOW, "Append", mode)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Streams that start inside keep these settings; the session's own are set again after."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffles_removed(spark: SparkSession):
    """What runs inside removes a query's or batch's shuffle files at its end, where they wait for a collection of the driver's memory else."""
    return _settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def state_store(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB; the session's own store is set again after."""
    store = "spark.sql.streaming.stateStore"
    return _settings(spark, {f"{store}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{store}.rocksdb.changelogCheckpointing.enabled": "true"})


def _dealt(spark: SparkSession, partitions: int | None):
    """Streams that start inside read a batch by four tasks or more a core (by one each, a task left over for a second turn doubles the batch's time) and keep at most so many partitions of state, each of which costs about as much as a few MB of texts in every batch."""
    least = 4 * spark.sparkContext.defaultParallelism
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shuffled = shuffled if partitions is None else min(shuffled, max(least, partitions))
    return _settings(spark, {"spark.sql.files.minPartitionNum": str(least), "spark.sql.shuffle.partitions": str(shuffled)})


def run_available(stream: DataFrame, path: str, checkpoint: str, partitions: int | None = None) -> tuple[DataFrame, int]:
    """(the table at path, micro-batches): what has arrived is processed and appended, from where the checkpoint left off.

    With ``partitions``, such as the files of a batch, a new stream's state has so many, or four a core, but no more than the session's shuffles.
    """
    spark = stream.sparkSession
    with state_store(spark), shuffles_removed(spark), _dealt(spark, partitions):
        query = stream.writeStream.format("parquet").option("compression", "zstd").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
        query.awaitTermination()
    batches = sum(p["numInputRows"] > 0 for p in query.recentProgress)
    return spark.read.schema(stream.schema).parquet(path), batches
