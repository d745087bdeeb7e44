"""The Pareto front of up to three goals, by sweeps over ranges instead of comparisons of all pairs.

Distinct goals are dealt to ranges of the first goal, and each range drops what it beats itself
in one sweep. What is left can only be beaten by an earlier range, in the other two goals. It
is dealt to ranges of the second goal: the least third goal for each pair of ranges, a table
of bounded size, settles all but pairs within one range of the second goal, and those are
settled by a sweep there.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.sinks import written

_GOALS = "x double, y double, z double"


def local_front(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Numbers of the points, all different, that no other point is below or equal to in all goals."""
    order = np.lexsort((z, y, x))
    ys, zs, kept = [], [], []  # the stairs that earlier points leave: y rising, z falling
    for i, b, c in zip(order.tolist(), y[order].tolist(), z[order].tolist(), strict=True):
        at = bisect_right(ys, b)
        if at and zs[at - 1] <= c:
            continue
        kept.append(i)
        start = bisect_left(ys, b)
        end = start
        while end < len(ys) and zs[end] >= c:
            end += 1
        ys[start:end], zs[start:end] = [b], [c]
    return np.array(kept, np.int64)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = [b for b in batches if b.num_rows]
    if tables:
        table = pa.Table.from_batches(tables)
        yield from table.take(pa.array(local_front(*(table.column(c).to_numpy() for c in "xyz")))).to_batches(max_chunksize=10_000)


def beaten_by_earlier(part: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Whether a point of an earlier part has no larger y and z. A tree over the parts holds the least z so far, in the order of y."""
    size = int(part.max(initial=0)) + 1
    tree = [np.inf] * (size + 1)
    out = np.zeros(len(part), bool)
    order = np.argsort(y, kind="stable")
    parts, zs = part[order].tolist(), z[order].tolist()
    edges = np.concatenate((np.flatnonzero(np.diff(y[order], prepend=np.nan) != 0), [len(order)])).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        for k in range(a, b):  # points of one y first enter together
            at = parts[k] + 1
            while at <= size:
                if zs[k] < tree[at]:
                    tree[at] = zs[k]
                at += at & -at
        for k in range(a, b):
            at, least = parts[k], np.inf
            while at:
                least = min(least, tree[at])
                at -= at & -at
            out[order[k]] = least <= zs[k]
    return out


def _inside(table: pa.Table) -> pa.Table:
    beaten = beaten_by_earlier(table.column("part").to_numpy(), table.column("y").to_numpy(), table.column("z").to_numpy())
    return table.filter(pa.array(~beaten)).select(["x", "y", "z"])


def _goal(c: str, sign: int) -> Column:
    v = F.col(f"`{c}`").cast("double") * sign
    return F.when(F.isnan(v), float("inf")).otherwise(v) + F.lit(0.0)  # there is one zero


def pareto_front(trials: DataFrame, low: tuple[str, ...] = ("loss_mean", "stability_mean"), high: tuple[str, ...] = ("speed_mean",), parts: int = 64) -> DataFrame:
    """Trials that no other beats in one goal and equals or beats in all others: ``low`` goals are better when lower, ``high`` ones when higher.

    Trials of equal goals stay or go together. A trial without one of its goals can't be
    compared and stays; nan is the worst of its goal. An empty table gives an empty one.
    ``parts`` ranges of each of two goals are used; what is broadcast has their square as rows.
    """
    goals = [_goal(c, 1) for c in low] + [_goal(c, -1) for c in high]
    if not 0 < len(goals) <= 3:
        raise ValueError("a front has one to three goals")
    names = [f"_goal_{c}" for c in "xyz"]
    keyed = trials.withColumns(dict(zip(names, [*goals, *[F.lit(0.0)] * (3 - len(goals))], strict=True)))
    known = F.lit(True)
    for n in names:
        known = known & F.col(n).isNotNull()
    points = keyed.where(known).select(*(F.col(n).alias(n[-1]) for n in names)).distinct()
    fronts = points.repartitionByRange(parts, "x").withColumn("part", F.spark_partition_id()).mapInArrow(_local, f"{_GOALS}, part int")
    dealt = written(written(fronts, "fronts").repartitionByRange(parts, "y").withColumn("bucket", F.spark_partition_id()), "dealt")
    least = np.full((parts + 1, parts + 1), np.inf)
    for r in dealt.groupBy("part", "bucket").agg(F.min("z").alias("z")).collect():  # parts * parts rows at most
        least[r["part"] + 1, r["bucket"] + 1] = r["z"]
    least = np.minimum.accumulate(np.minimum.accumulate(least, axis=0), axis=1)
    bounds = [(p, b, float(least[p, b])) for p in range(parts) for b in range(parts) if least[p, b] < np.inf]
    before = trials.sparkSession.createDataFrame(bounds, "part int, bucket int, least double")
    left = dealt.join(F.broadcast(before), ["part", "bucket"], "left").where("least is null or least > z")
    front = left.select("x", "y", "z", "part", "bucket").groupBy("bucket").applyInArrow(_inside, _GOALS).toDF(*names)
    return keyed.where(known).join(front, names, "left_semi").drop(*names).unionByName(keyed.where(~known).drop(*names))
