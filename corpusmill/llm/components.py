"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (each node's smallest known index) after joining a[i] with b[i] for every i."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            break
        least = np.minimum(la, lb)
        np.minimum.at(labels, la, least)
        np.minimum.at(labels, lb, least)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a batch as stars around the smallest node of each piece."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
        labels = merged(np.arange(len(nodes)), index[: len(a)], index[len(a) :])
        leaf = labels != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[labels[leaf]])], ["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or the smaller) neighbours of each node to its smallest neighbour.

    The smallest neighbour comes from an aggregate with map-side combine and a join, not from a
    window, so that a node with very many neighbours is no single task.
    """
    both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    found = both.join(least, "a")
    if large:
        return found.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return found.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a long, b long); component is the smallest node that is reachable.

    Alternates large-star and small-star until every edge ends at its component's smallest
    node. Self-links add nothing; nodes without an edge don't appear.
    """
    edges = cut(edges.where("a <> b").toDF("a", "b").mapInArrow(_contract, "a long, b long").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        edges = cut(_star(_star(edges, large=True), large=False))
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
