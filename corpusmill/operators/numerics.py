"""Kernels over arrays: rotary positions, mixing of residual states, and a recurrence with resets as a scan over affine maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import let
from corpusmill.sources.sinks import written


def rotary(x: Column, position: Column, size: int, theta: float = 10_000.0) -> Column:
    """x (``size`` values) turned by its position: halves i and i + size / 2 by position / theta ** (2 i / size)."""
    half = size // 2
    angle = lambda i: position / F.pow(F.lit(theta), F.pmod(i, F.lit(half)) * 2 / size)
    other = lambda i: F.when(i < half, -F.get(x, i + half)).otherwise(F.get(x, i - half))
    return F.transform(x, lambda v, i: v * F.cos(angle(i)) + other(i) * F.sin(angle(i)))


def residual_mix(states: Column, query: Column, weight: Column, eps: float = 1e-6) -> Column:
    """Softmax-weighted mean of states (arrays of one length): logits are the products of each state, scaled to unit mean square, with weight * query."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    direction = F.zip_with(weight, query, lambda p, q: p * q)
    logits = F.transform(states, lambda s: dot(s, direction) / F.sqrt(dot(s, s) / F.size(s) + eps))
    shares = let(let(logits, lambda g: F.transform(g, lambda v: F.exp(v - F.array_max(g)))), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, y: s + y)))
    zero = F.transform(F.get(states, F.lit(0)), lambda v: v * 0.0)
    return let(shares, lambda w: F.aggregate(F.arrays_zip(states.alias("s"), w.alias("w")), zero, lambda acc, x: F.zip_with(acc, x["s"], lambda p, q: p + x["w"] * q)))


_FIELDS = ("r", "k", "v", "w", "a", "b")
_MAP = "seq long, at long, m binary, g binary"
_STATE = "seq long, at long, state binary"


def _whole_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows come sorted by seq and chunk; those of the last chunk wait for the next batch."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        seq, chunk = held.column("seq").to_numpy(), held.column("chunk").to_numpy()
        tail = np.flatnonzero((seq != seq[-1]) | (chunk != chunk[-1])) if len(seq) else seq
        keep = int(tail[-1]) + 1 if len(tail) else 0
        if keep:
            yield held.slice(0, keep)
            held = held.slice(keep)
    if held is not None and len(held):
        yield held


class _Steps:
    """Chunks of steps side by side: place p of every chunk is one step of all of them."""

    def __init__(self, table: pa.Table, width: int) -> None:
        self.seq, self.chunk = table.column("seq").to_numpy(), table.column("chunk").to_numpy()
        new = np.concatenate(([True], (self.seq[1:] != self.seq[:-1]) | (self.chunk[1:] != self.chunk[:-1])))
        self.first = np.flatnonzero(new)
        self.row = np.cumsum(new) - 1
        self.place = np.arange(len(new)) - self.first[self.row]
        self.size, self.width, self.longest = len(self.first), width, int(self.place.max()) + 1
        self.live = self._spread(np.ones(len(new), bool))
        self.keep = self._spread(~np.array(table.column("reset").to_numpy(zero_copy_only=False), bool)).astype(float)
        self.fields = {c: self._spread(table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)) for c in _FIELDS}

    def _spread(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((self.longest, self.size, *rows.shape[1:]), rows.dtype)
        out[self.place, self.row] = rows
        return out

    def moved(self, state: np.ndarray, p: int, gain: bool) -> np.ndarray:
        """States of all chunks after place p; without the gain it is the step's linear part."""
        x = {c: f[p] for c, f in self.fields.items()}
        before = state * self.keep[p][:, None, None]
        after = before * x["w"][:, None, :] + np.einsum("nij,nj->ni", before, x["a"])[:, :, None] * x["b"][:, None, :]
        if gain:
            after = after + x["v"][:, :, None] * x["k"][:, None, :]
        return np.where(self.live[p][:, None, None], after, state)


def _maps(width: int):
    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each chunk makes of a state s: s m + g."""
        for table in _whole_chunks(batches):
            steps = _Steps(table, width)
            m, g = np.tile(np.eye(width), (steps.size, 1, 1)), np.zeros((steps.size, width, width))
            for p in range(steps.longest):
                m, g = steps.moved(m, p, gain=False), steps.moved(g, p, gain=True)
            columns = [pa.array(steps.seq[steps.first]), pa.array(steps.chunk[steps.first]), pa.array([x.tobytes() for x in m], pa.binary()), pa.array([x.tobytes() for x in g], pa.binary())]
            yield pa.record_batch(columns, names=["seq", "at", "m", "g"])

    return maps


def _matrices(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.stack([np.frombuffer(x).reshape(width, width) for x in column.to_pylist()])


def _composed(width: int):
    def composed(table: pa.Table) -> pa.Table:
        """A group of maps in order as one."""
        table = table.sort_by("at")
        m, g = np.eye(width), np.zeros((width, width))
        for a, b in zip(_matrices(table.column("m"), width), _matrices(table.column("g"), width), strict=True):
            m, g = m @ a, g @ a + b
        return pa.table([table.column("seq").slice(0, 1), table.column("up").slice(0, 1), pa.array([m.tobytes()], pa.binary()), pa.array([g.tobytes()], pa.binary())], names=["seq", "at", "m", "g"])

    return composed


def _entered(width: int):
    def entered(maps: pa.Table, above: pa.Table) -> pa.Table:
        """The state before each map of a group, from that before the group (zero at a sequence's begin)."""
        maps = maps.sort_by("at")
        state = _matrices(above.column("state"), width)[0] if len(above) else np.zeros((width, width))
        out = []
        for a, b in zip(_matrices(maps.column("m"), width), _matrices(maps.column("g"), width), strict=True):
            out.append(state.tobytes())
            state = state @ a + b
        return pa.table([maps.column("seq"), maps.column("at"), pa.array(out, pa.binary())], names=["seq", "at", "state"])

    return entered


def _outputs(width: int):
    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's first row, but for a sequence's first chunk, holds the state before it and no step."""
        for table in _whole_chunks(batches):
            heads = table.filter(pa.compute.is_valid(table.column("state")))
            table = table.filter(pa.compute.is_null(table.column("state")))
            steps = _Steps(table, width)
            state = np.zeros((steps.size, width, width))  # at a sequence's begin there is no head
            if len(heads):
                chunks = pd.MultiIndex.from_arrays([steps.seq[steps.first], steps.chunk[steps.first]])
                state[chunks.get_indexer(pd.MultiIndex.from_arrays([heads.column("seq").to_numpy(), heads.column("chunk").to_numpy()]))] = _matrices(heads.column("state"), width)
            out = np.zeros((steps.longest, steps.size, width))
            for p in range(steps.longest):
                state = steps.moved(state, p, gain=True)
                out[p] = np.einsum("nij,nj->ni", state, steps.fields["r"][p])
            flat = out[steps.place, steps.row].ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat))
            for batch in pa.table([table.column("seq"), table.column("t"), lists], names=["seq", "t", "out"]).to_batches():
                yield batch

    return outputs


def recurrence(steps: DataFrame, width: int, chunk: int = 64, group: int = 64) -> DataFrame:
    """(seq, t, out) of steps (seq, t, reset, r, k, v, w, a, b): a matrix state decays by w, is projected by a onto b and gains v k; out is the state times r.

    A step is an affine map of the state, and a reset one that forgets it, so maps compose: steps
    become chunks of ``chunk`` numbers t, ``group`` chunks one map, and so on until a sequence is
    one group. On the way back each gets the state before it, and chunks give their outputs by
    themselves. A sequence of any length, with resets or without, is as many tasks as it has
    chunks. t is a whole number from 0 that orders a sequence, gaps are allowed; arrays have
    ``width`` values, none of them null. An empty table gives an empty result.
    """
    rows = written(steps.select("seq", "t", F.floor(F.col("t") / chunk).alias("chunk"), F.coalesce("reset", F.lit(False)).alias("reset"), *_FIELDS), "steps")
    # a sequence of one chunk begins with no state, which its outputs need no map for
    long = rows.join(rows.where("chunk > 0").select("seq").distinct(), "seq", "left_semi")
    dealt = long.repartition("seq", "chunk").sortWithinPartitions("seq", "chunk", "t")
    levels = [written(dealt.mapInArrow(_maps(width), _MAP), "maps")]
    while (levels[-1].agg(F.max("at")).first()[0] or 0) >= group:
        up = levels[-1].withColumn("up", F.floor(F.col("at") / group))
        levels.append(written(up.groupBy("seq", "up").applyInArrow(_composed(width), _MAP), "maps"))
    states = steps.sparkSession.createDataFrame([], _STATE)
    for maps in reversed(levels):
        below = maps.withColumn("up", F.floor(F.col("at") / group)).groupBy("seq", "up")
        states = below.cogroup(states.withColumnRenamed("at", "up").groupBy("seq", "up")).applyInArrow(_entered(width), _STATE)
    heads = states.where("at > 0").select("seq", F.col("at").alias("chunk"), "state")
    both = rows.unionByName(heads, allowMissingColumns=True).repartition("seq", "chunk").sortWithinPartitions("seq", "chunk", F.col("t").asc_nulls_first())
    return both.mapInArrow(_outputs(width), "seq long, t long, out array<double>")
