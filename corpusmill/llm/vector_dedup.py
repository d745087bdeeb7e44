"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the vectors again and again at the median of a random projection; vectors
near a split go to both sides (spill). The forest is fitted on a bounded sample, and every
vector is routed through it. Two vectors are compared, in double precision, where they share
a leaf; the trees' findings are united. A pair counts once, in the first leaf that it shares,
which its two lists of leaves tell without any table of pairs. Links leave a task as stars
around the smallest index of each piece and as sums, so what leaves it grows with its rows.

A vector moves once for each *branch* of a tree that it reaches, a subtree of as many rows as a
task can hold, and not once for each leaf; the task compares within every leaf of the branch.
Equal vectors are one class, compared once. A node whose vectors lie within the spill margin,
as a dense group's do, is not split further; branches of over ``2 * branch_bytes`` are compared
as pairs of chunks in separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from corpusmill.llm.common import NO_ID, cut
from corpusmill.llm.components import components, merged


@dataclass(frozen=True)
class Forest:
    """``directions``: tree x level x dimension. ``splits``: tree x node, heap order from 1, NaN for leaves."""

    directions: np.ndarray
    splits: np.ndarray
    margin: float


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; safe for very large and very small components."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors as float64 rows; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def fit_forest(sample: np.ndarray, trees: int, leaf: int, margin: float, seed: int = 7, depth: int = 16) -> Forest:
    """A forest whose leaves hold about ``leaf`` of the sample's unit vectors; nodes with over half of theirs inside the margin stay whole."""
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((trees, depth, sample.shape[1]))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    splits = np.full((trees, 1 << depth), np.nan)
    for t in range(trees):
        todo = [(1, 0, np.arange(len(sample)))]
        while todo:
            node, level, own = todo.pop()
            if len(own) <= leaf or level == depth - 1:
                continue
            at = sample[own] @ directions[t, level]
            middle = float(np.median(at))
            if np.mean(np.abs(at - middle) < margin) > 0.5:
                continue
            splits[t, node] = middle
            todo += [(2 * node, level + 1, own[at < middle]), (2 * node + 1, level + 1, own[at >= middle])]
    used = 1 + int(np.flatnonzero(~np.isnan(splits).all(axis=0)).max(initial=0))
    return Forest(directions[:, : used.bit_length()], splits[:, :used], margin)


def leaves_of(rows: np.ndarray, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for every leaf that each unit vector reaches, by row and leaf."""
    found = []
    size = 2 * forest.splits.shape[1]
    for t in range(len(forest.splits)):
        row, node = np.arange(len(rows)), np.ones(len(rows), np.int64)
        for level in range(forest.directions.shape[1] + 1):
            split = np.where(node < forest.splits.shape[1], forest.splits[t][np.minimum(node, forest.splits.shape[1] - 1)], np.nan)
            done = np.isnan(split)
            found.append((row[done], t * size + node[done]))
            row, node, split = row[~done], node[~done], split[~done]
            if not len(row):
                break
            at = (rows @ forest.directions[t, level])[row]
            left, right = at < split + forest.margin, at >= split - forest.margin
            row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
    row, leaf = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((leaf, row))
    return row[order], leaf[order]


def branch_of(leaf: np.ndarray, size: int, depth: int) -> np.ndarray:
    """The branch of each leaf: its tree's node above it at the depth given, or itself if it is not that deep."""
    tree, node = leaf // size, leaf % size
    level = np.frexp(np.maximum(node, 1).astype(float))[1] - 1
    return tree * size + (node >> np.maximum(level - depth, 0))


def _listed(row: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _route(forest: Forest, width: int, depth: int):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, leaf = leaves_of(unit(_matrix(batch.column("vector"), width)), forest)
            branch = branch_of(leaf, 2 * forest.splits.shape[1], depth)
            own = np.unique(row * (1 << 32) + branch)
            yield pa.RecordBatch.from_arrays([*batch.columns, _listed(row, leaf, batch.num_rows), _listed(own >> 32, own & ((1 << 32) - 1), batch.num_rows)], [*batch.schema.names, "leaves", "branches"])

    return route


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that is in both rows a[i] and b[i]; rows ascend and end in -1 and -2."""
    out = np.full(len(a), -1, np.int64)
    left = np.arange(len(a))
    for k in range(a.shape[1]):
        hit = (a[left, k, None] == b[left]).any(axis=1)
        out[left[hit]] = a[left[hit], k]
        left = left[~hit]
        if not len(left):
            break
    return out


def _compare(width: int, least: float, size: int, depth: int, rows_at_once: int = 512, pairs_at_once: int = 1 << 17):
    def compare(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        nodes, copies = (table.column(c).to_numpy() for c in ("node", "copies"))
        chunk, branch = table.column("chunk").to_numpy(), key[0].as_py()
        rows = unit(_matrix(table.column("vector"), width))
        lists = table.column("leaves").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        leaves = np.full((len(nodes), int(sizes.max())), -1, np.int32)
        leaves[np.arange(leaves.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
        other = np.where(leaves < 0, -2, leaves)
        row, leaf = np.repeat(np.arange(len(nodes)), sizes), lists.flatten().to_numpy().astype(np.int64)
        mine = branch_of(leaf, size, depth) == branch
        row, leaf = row[mine], leaf[mine]
        order = np.argsort(leaf, kind="stable")
        row, leaf = row[order], leaf[order]
        same = key[1].as_py() == key[2].as_py()
        links, labels = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        edges = np.concatenate(([0], np.flatnonzero(np.diff(leaf)) + 1, [len(leaf)])).tolist()
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            own = row[start:end]
            low, high = own[chunk[own] == key[1].as_py()], own[chunk[own] == key[2].as_py()]
            for a in range(0, len(low), rows_at_once):
                some = low[a : a + rows_at_once]
                close = rows[some] @ rows[high].T >= least
                if same:
                    close &= some[:, None] < high[None, :]
                i, j = np.nonzero(close)
                i, j = some[i], high[j]
                labels = merged(labels, i, j)
                for b in range(0, len(i), pairs_at_once):
                    p, q = i[b : b + pairs_at_once], j[b : b + pairs_at_once]
                    first = _first_shared(leaves[p], other[q]) == leaf[start]
                    links += np.bincount(p[first], copies[q[first]], len(nodes)).astype(np.int64) + np.bincount(q[first], copies[p[first]], len(nodes)).astype(np.int64)
        linked, leaf_nodes = np.flatnonzero(links), np.flatnonzero(labels != np.arange(len(labels)))
        a = np.concatenate((nodes[linked], nodes[leaf_nodes]))
        b = np.concatenate((nodes[linked], nodes[labels[leaf_nodes]]))
        return pa.table([pa.array(a), pa.array(b), pa.array(np.concatenate((links[linked], np.zeros(len(leaf_nodes), np.int64))))], names=["a", "b", "n"])

    return compare


def vector_groups(vectors: DataFrame, least: float = 0.95, trees: int = 6, leaf: int = 256, margin: float = 0.02, sample_rows: int = 20_000, branch_bytes: int = 8 << 20) -> DataFrame:
    """For each row of vectors (vec_id, embedding): n_links, component_id and kept.

    A link joins two rows whose cosine is at least ``least``. Vectors that are null, empty, zero
    or hold a null or non-finite component link with nothing and are their own component; of
    vectors of different lengths the shorter one counts as ending in zeros. Equal rows are
    linked to each other. A null vec_id counts as larger than any and is not kept. The forest
    is fitted on about ``sample_rows`` distinct vectors, four of them in a leaf at least; all
    are routed and compared. Of a component's rows the one with the smallest vec_id is kept, all
    of these if several share it. Other columns are ignored, and an empty table gives an empty
    result.
    """
    kind = "float" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    usable = (F.size("vector") > 0) & F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("key", F.when(F.col("usable"), F.struct(F.xxhash64("vector").alias("h"), F.xxhash64(F.lit("second"), "vector").alias("i"))))
    ids = F.coalesce("vec_id", F.lit(NO_ID))
    classes = cut(rows.where("usable").groupBy("key").agg(F.min(ids).alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector")))
    n, width = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    if n:
        every = max(1, n // sample_rows)
        sample = classes.where(F.pmod(F.col("key.h"), F.lit(every)) == 0).select("vector").toArrow()
        forest = fit_forest(unit(_matrix(sample.column("vector"), width)), trees, max(4, leaf // every), margin) if sample.num_rows else fit_forest(np.eye(1, width), trees, leaf, margin)
        size, most = 2 * forest.splits.shape[1], max(1, branch_bytes // (8 * width))
        depth = max(0, (n // most).bit_length())
        routed = classes.select("node", "copies", "vector").mapInArrow(_route(forest, width, depth), f"node long, copies long, vector array<{kind}>, leaves array<int>, branches array<int>")
        entries = routed.select("node", "copies", "vector", "leaves", F.explode("branches").alias("branch"))
        tile = 2 * most
        large = entries.groupBy("branch").count().where(F.col("count") > tile).select("branch", F.ceil(F.col("count") / tile).alias("chunks"))
        mine = F.coalesce(F.pmod(F.xxhash64("node", "branch"), F.col("chunks")), F.lit(0))
        others = F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1)
        # large is broadcast: it has at most a row for each node of the forest, whose size sample_rows bounds
        dealt = entries.join(F.broadcast(large), "branch", "left").withColumn("chunk", mine).select("branch", "node", "copies", "vector", "leaves", "chunk", F.explode(others).alias("with"))
        dealt = dealt.withColumn("low", F.least("chunk", "with")).withColumn("high", F.greatest("chunk", "with"))
        found = cut(dealt.groupBy("branch", "low", "high").applyInArrow(_compare(width, least, size, depth), "a long, b long, n long"))
    else:
        found = vectors.sparkSession.createDataFrame([], "a long, b long, n long")
    links = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    by_class = classes.select("key", "node", "copies").join(links, "node", "left").join(components(found.select("a", "b")), "node", "left")
    by_class = by_class.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("component"))
    joined = rows.where("usable").select("vec_id", "key").join(by_class, "key").select("vec_id", "n", "component")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component"))
    component = F.nullif(F.coalesce("component", "vec_id"), F.lit(NO_ID))
    return joined.union(alone).select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
