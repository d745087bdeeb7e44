"""Objects of JSON arrays, read by as many tasks as a file has splits.

A line of a JSON array need not begin or end a record, so files are split at "}" instead, which
every object ends with. Whether such a fragment lies in a string, and how deep, depends on all
before it. So each split gives, for both cases (it begins inside a string or not), how it ends,
by how much the depth changes, and how many of its fragments end at each depth. From these a
prefix over the splits, a small table, tells each split the state it begins in. Tasks then
read their splits again and cut records where an object ends at depth one. Only records that
lie across splits are joined by a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SPLIT = "path string, file string, block long, size long, n long, bytes long, inside int, d0 long, d1 long, low0 long, low1 long, array boolean, at0 array<long>, ends0 array<long>, at1 array<long>, ends1 array<long>"
_SPLIT_NAMES = [c.split()[0] for c in _SPLIT.split(", ")]
_PIECE = "path string, file string, number long, block long, piece string, ended boolean, whole boolean, closed boolean"
_PIECE_NAMES = [c.split()[0] for c in _PIECE.split(", ")]
_OPENS, _CLOSES, _BACKSLASH, _QUOTE = b"[{", b"]}", ord("\\"), ord('"')
_FAR = 1 << 40


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    meta = {"path": "file_path", "file": "file_name", "block": "file_block_start", "size": "file_size"}
    return spark.read.option("lineSep", "}").text(path).select(*(F.col(f"_metadata.{m}").alias(c) for c, m in meta.items()), "value")


def _runs(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of fragments of one split, of about ``most`` bytes, with their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        value = table.column("value").combine_chunks().cast(pa.large_binary())
        value = value if isinstance(value, pa.Array) else value.chunk(0)
        offsets = np.frombuffer(value.buffers()[1], np.int64)[value.offset : value.offset + len(value) + 1]
        data = np.frombuffer(value.buffers()[2] or b"", np.uint8)
        path, block = batch.column("path").to_pylist(), batch.column("block").to_numpy()
        begin = 0
        for k in range(1, len(value) + 1):
            if k == len(value) or block[k] != block[begin] or path[k] != path[begin] or offsets[k] - offsets[begin] > most:
                own = offsets[begin : k + 1]
                yield batch.slice(begin, k - begin), data[own[0] : own[-1]], own - own[0]
                begin = k


def _quotes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of the quotes that no backslash escapes. A fragment begins after "}", so no escape reaches into it."""
    at = np.flatnonzero(data == _QUOTE)
    begin = offsets[np.searchsorted(offsets, at, "right") - 1]
    slashes, live, k = np.zeros(len(at), np.int64), np.arange(len(at)), 1
    while len(live):
        live = live[at[live] - k >= begin[live]]
        live = live[data[at[live] - k] == _BACKSLASH]
        slashes[live] += 1
        k += 1
    return at[slashes % 2 == 0]


class _Events:
    """Brackets and fragments' ends of a run in order: where they are, by how much they change the depth, and in a string or not, if the run begins outside of one."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        quotes = _quotes(data, offsets)
        opens, closes = ((data == pair[0]) | (data == pair[1]) for pair in (_OPENS, _CLOSES))  # a byte each, where isin takes eight
        brackets = np.flatnonzero(opens | closes)
        places = np.concatenate((brackets, offsets[1:]))
        order = np.argsort(np.concatenate((2 * brackets + 1, 2 * offsets[1:])), kind="stable")
        self.at = places[order]
        self.change = np.concatenate((np.where(opens[brackets], 1, -1), np.full(len(offsets) - 1, -1)))[order]
        self.parity = np.searchsorted(quotes, self.at) & 1
        self.ends = np.flatnonzero(order >= len(brackets))  # the events that end a fragment, in the fragments' order
        self.quotes = len(quotes)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split."""
    own, row = None, {}

    def done() -> pa.RecordBatch:
        for h in (0, 1):
            row[f"at{h}"], row[f"ends{h}"] = list(row[f"hist{h}"]), list(row[f"hist{h}"].values())
        schema = pa.schema([(c, pa.string() if c in ("path", "file") else pa.bool_() if c == "array" else pa.int32() if c == "inside" else pa.list_(pa.int64()) if c[:2] == "at" or c[:4] == "ends" else pa.int64()) for c in _SPLIT_NAMES])
        return pa.RecordBatch.from_pylist([{c: row[c] for c in _SPLIT_NAMES}], schema=schema)

    for run, data, offsets in _runs(batches):
        key = run.column("path")[0].as_py(), run.column("block")[0].as_py()
        if key != own:
            if own:
                yield done()
            head = data[: offsets[1]].tobytes().lstrip()
            own, row = key, {"path": key[0], "block": key[1], "file": run.column("file")[0].as_py(), "size": run.column("size")[0].as_py(), "array": head[:1] == b"[", "n": 0, "bytes": 0, "inside": 0} | {f"d{h}": 0 for h in (0, 1)} | {f"low{h}": _FAR for h in (0, 1)} | {f"hist{h}": Counter() for h in (0, 1)}
        events = _Events(data, offsets)
        parity = events.parity ^ row["inside"]
        for h in (0, 1):
            depth = row[f"d{h}"] + np.cumsum(np.where(parity == h, events.change, 0))
            real = parity == h
            row[f"low{h}"] = min(row[f"low{h}"], int(depth[real].min(initial=_FAR)))
            ends = events.ends[real[events.ends]]
            row[f"hist{h}"].update(depth[ends].tolist())
            row[f"d{h}"] = int(depth[-1])
        row["inside"] = int(row["inside"] ^ events.quotes & 1)
        row["n"] += run.num_rows
        row["bytes"] += len(data) + run.num_rows
    if own:
        yield done()


def _entered(splits: DataFrame) -> DataFrame:
    """The state that each split begins in: inside a string or not, the depth, and the records that end before."""
    w = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    chosen = lambda c: F.when(F.col("entry") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    s = splits.withColumn("entry", (before("inside") % 2).cast("int"))
    s = s.withColumns({c: chosen(c) for c in ("d", "low", "at", "ends")}).withColumn("depth", before("d"))
    here = F.get("ends", (F.array_position("at", 1 - F.col("depth")) - 1).cast("int"))
    s = s.withColumn("here", F.when(F.array_contains("at", 1 - F.col("depth")), here).otherwise(0)).withColumn("base", before("here"))
    s = s.withColumn("over", (F.col("depth") + F.col("low") <= 0).cast("int")).withColumn("closed", before("over") > 0)
    every = Window.partitionBy("path")
    left = F.sum("bytes").over(every) - F.col("size")  # 1 if the file doesn't end with "}"; a mark of three bytes at its start isn't counted
    s = s.withColumn("cut", (F.col("block") == F.max("block").over(every)) & left.isin(1, -2))
    s = s.withColumn("array", F.max(F.when(F.col("block") == 0, F.col("array"))).over(every))
    return s.where("array and not closed").select("path", "block", "n", "entry", "depth", "base", "cut")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, and what is left of a split before its first and after its last record."""
    own, held, rows = None, [], []
    inside = depth = number = seen = 0
    first = over = False

    def batch_of(rows: list) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_PIECE_NAMES)

    def tail(closed: bool) -> tuple:
        return (*own[:2], number, own[2], b"".join(held).decode(errors="replace"), False, False, closed)

    for run, data, offsets in _runs(batches):
        at = lambda c, run=run: run.column(c)[0].as_py()
        key = at("path"), at("file"), at("block")
        if key != own:
            if own and not over:
                rows.append(tail(False))
            own, held, over, seen = key, [], False, 0
            inside, depth, number = 0, at("depth"), at("base")
            first = own[2] > 0  # the first record of a later split may begin before it
        if over:
            continue
        events, h, raw = _Events(data, offsets), at("entry"), data.tobytes()
        real = (events.parity ^ inside) == h
        depths = depth + np.cumsum(np.where(real, events.change, 0))
        shut = np.flatnonzero(real & (depths <= 0))
        last = shut[0] if len(shut) else len(depths)
        begin = 0
        # the file's last fragment has no "}" where the file doesn't end with one
        bare = run.num_rows - 1 if at("cut") and seen + run.num_rows == at("n") else -1
        found = np.flatnonzero(real[events.ends] & (depths[events.ends] == 1) & (events.ends < last))
        for f in found.tolist():
            if f == bare:
                break
            parts = [raw[a:b] for a, b in zip(offsets[begin : f + 1].tolist(), offsets[begin + 1 : f + 2].tolist(), strict=True)]
            text = b"".join(held) + b"}".join(parts) + b"}"
            rows.append((*own[:2], number, own[2], text.decode(errors="replace"), True, not first, False))
            held, begin, number, first = [], f + 1, number + 1, False
            if len(rows) >= 1000:
                yield batch_of(rows)
                rows = []
        if len(shut):
            end = int(events.at[last])
            parts = [raw[a : min(b, end)] for a, b in zip(offsets[begin:-1].tolist(), offsets[begin + 1 :].tolist(), strict=True) if a < end]
            held.append(b"}".join(parts))
            rows.append(tail(True))
            over = True
            continue
        for f in range(begin, run.num_rows):
            held.append(raw[offsets[f] : offsets[f + 1]] + (b"" if f == bare else b"}"))
        inside, depth, seen = int(inside ^ events.quotes & 1), int(depths[-1]), seen + run.num_rows
    if own and not over:
        rows.append(tail(False))
    if rows:
        yield batch_of(rows)


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, row_idx, record, whole) of the objects that the JSON arrays at path hold, by their place among a file's objects.

    Files of anything else give no rows, elements that aren't objects are passed over, and what
    follows the array's end is ignored. Where an array is broken, its objects before that come
    out, and whole is false; an array that just stops between two elements counts as whole. A
    file is read by as many tasks as it has splits, twice.
    """
    parts = _fragments(spark, path)
    splits = parts.mapInArrow(_summaries, _SPLIT)
    # a row for each split of the files, whose list the driver holds anyway
    placed = parts.join(F.broadcast(_entered(splits)), ["path", "block"])
    pieces = placed.mapInArrow(_pieces, _PIECE)
    joined = pieces.where("not whole").groupBy("path", "file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "piece"))).alias("p"), F.max("ended").alias("ended"))
    texts = pieces.where("whole").select("path", "file", "number", "piece", "ended")
    texts = texts.union(joined.select("path", "file", "number", F.array_join("p.piece", "").alias("piece"), "ended"))
    opened = F.when(F.col("number") == 0, F.regexp_replace("piece", r"^\s*\[", "")).otherwise(F.col("piece"))
    listed = F.concat(F.lit("["), F.regexp_replace(F.regexp_replace(opened, r"^[\s,]+", ""), r"[\s,]+$", ""), F.lit("]"))
    texts = texts.select("path", "file", "number", "ended", listed.alias("listed")).withColumn("bad", F.try_parse_json("listed").isNull())
    broken = texts.where("bad").groupBy("path").agg(F.min("number").alias("until"))
    kept = texts.where("ended and not bad").join(broken, "path", "left").where("until is null or number < until")
    record = F.try_element_at(F.from_json("listed", "array<string>"), F.lit(-1))
    return kept.select("path", "file", F.col("number").alias("row_idx"), record.alias("record"), F.col("until").isNull().alias("whole"))
