"""Whitening of embeddings by a one-sided Jacobi SVD of the triangle that a blockwise TSQR leaves.

Entries become whole numbers, so counts, sums and deviations are exact. Tasks compress the
centred rows that they hold to one triangle each, triangles are stacked and compressed again in
groups until one is left, and plane rotations make its columns orthogonal: their norms are the
singular values, and the rotations' product holds the components. No covariance matrix is
formed on the way, so small deviations keep their accuracy. What a task or the driver holds
besides a batch of rows has the square of the vectors' width, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, shared_path

#: Larger whole entries, of vectors beyond any use, count as this.
FARTHEST = 1 << 50
_LONGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """What a table's fit list gives: its size, exact sums, and the components (columns) by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n of whole rows, from exact n*x - S where that fits 64 bits."""
        if len(x) and self.n * (int(np.abs(x).max()) + max(map(abs, self.sums), default=0) // max(self.n, 1) + 1) < _LONGEST:
            return (self.n * x - np.array(self.sums, np.int64)) / self.n
        mean = np.array([s / self.n for s in self.sums])
        return x - mean

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n*x - S)^2 for each whole row, exact; None where it doesn't fit a long."""
        farthest = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if farthest**2 * x.shape[1] <= _LONGEST:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        wide = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v <= _LONGEST else None for v in (wide * wide).sum(axis=1).tolist()]

    def positive(self, most: int) -> np.ndarray:
        """Which of the first ``most`` components have a variance that isn't just rounding."""
        e = self.eigenvalues
        return e[:most] > (e[0] if len(e) else 0) * (max(1, len(e)) * np.finfo(float).eps) ** 2

    def whitened(self, x: np.ndarray, most: int) -> np.ndarray:
        """Centred rows on the first components, each divided by its deviation; nan where that is zero."""
        scale = np.where(self.positive(most), self.eigenvalues[:most], np.nan)
        return self.centred(x) @ self.components[:, :most] / np.sqrt(scale)


def whole_rows(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column of whole numbers as rows of ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten() if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a QR decomposition, filled up with zeros to a square."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack((r, np.zeros((rows.shape[1] - len(r), rows.shape[1])))) if len(r) < rows.shape[1] else r


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of r, falling, and its right singular vectors as columns.

    One-sided: pairs of columns are rotated until all are orthogonal. A sweep is a round-robin
    tournament, so the pairs of a round share no column and are rotated together.
    """
    width = r.shape[1]
    a, v = r.astype(float).copy(), np.eye(width)
    seats = np.arange(width + width % 2)
    for _ in range(sweeps if width > 1 else 0):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            real = (p < width) & (q < width)
            p, q = p[real], q[real]
            alpha, beta = (a[:, p] ** 2).sum(axis=0), (a[:, q] ** 2).sum(axis=0)
            gamma = (a[:, p] * a[:, q]).sum(axis=0)
            off = np.abs(gamma) > np.finfo(float).eps * np.sqrt(alpha) * np.sqrt(beta)
            if off.any():
                turned = True
                p, q, alpha, beta, gamma = p[off], q[off], alpha[off], beta[off], gamma[off]
                zeta = (beta - alpha) / (2 * gamma)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                for m in (a, v):
                    m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
            seats = np.concatenate((seats[:1], seats[-1:], seats[1:-1]))
        if not turned:
            break
    sizes = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-sizes, kind="stable")
    v = v[:, order]
    heads = v[np.abs(v).argmax(axis=0), np.arange(width)]  # the largest entry of a component is made positive
    return sizes[order], v * np.where(heads < 0, -1.0, 1.0)


def _states(start: Callable, add: Callable) -> Callable:
    """A mapInArrow function that folds a task's batches into one state of doubles."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        seen = False
        for batch in batches:
            if batch.num_rows:
                state, seen = add(state, batch.column("x")), True
        if seen:
            place = TaskContext.get().partitionId()
            yield pa.record_batch([pa.array([place], pa.int64()), pa.array([state.tobytes()], pa.binary())], names=["place", "state"])

    return fold


def combined(states: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray], fan: int = 32) -> np.ndarray | None:
    """All tasks' states (place, state) merged to one, up to ``fan`` of them at a time; None without rows."""

    def of_group(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        merged = merge([np.frombuffer(s) for s in group.column("state").to_pylist()])
        return pa.table([pa.array([group.column("up")[0].as_py()], pa.int64()), pa.array([merged.tobytes()], pa.binary())], names=["place", "state"])

    states = cut(states)
    while states.count() > 1:
        up = states.withColumn("up", F.floor(F.col("place") / fan).cast("long"))
        states = cut(up.groupBy("up").applyInArrow(of_group, "place long, state binary"))
    last = states.first()
    return None if last is None else np.frombuffer(last["state"])


def usable_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, x): rows whose vector is neither null nor holds a null or non-finite entry, entries as whole numbers."""
    v = F.col("embedding").cast("array<double>")
    usable = F.coalesce(F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c)), F.lit(False))
    far = F.lit(float(FARTHEST))
    whole = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * scale, far), -far)).cast("long"))
    return vectors.where(usable).select(F.col("vec_id"), whole.alias("x"))


def fit(vectors: DataFrame, scale: int = 64, most: int = 16, block_rows: int = 4096) -> tuple[DataFrame, Whitening, int]:
    """(usable rows, what their distinct vectors give, vectors' width); the rows' x are filled up to the width."""
    rows = usable_vectors(vectors, scale)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    filled = rows.select("vec_id", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))).alias("x"))
    if not width:
        return filled, Whitening(rows.count() and 1, [], np.zeros((0, 0)), np.zeros(0)), 0
    path = shared_path(vectors.sparkSession, "fit-list")
    filled.select("x").distinct().write.parquet(path)  # copies meet as one row from each task
    listed = vectors.sparkSession.read.parquet(path)
    sums = {r[0]: int(r[1]) for r in listed.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(38,0)"))).collect()}
    n = listed.count()
    model = Whitening(n, [sums[i] for i in range(width)], np.zeros((width, 0)), np.zeros(0))

    def compress(r: np.ndarray, column: pa.Array) -> np.ndarray:
        x = whole_rows(column, width)
        for a in range(0, len(x), block_rows):
            r = triangle(np.vstack((r.reshape(-1, width), model.centred(x[a : a + block_rows]))))
        return r

    r = combined(
        listed.mapInArrow(_states(lambda: np.zeros((0, width)), compress), "place long, state binary"),
        lambda found: triangle(np.vstack([f.reshape(-1, width) for f in found])),
    ).reshape(-1, width)
    sizes, components = jacobi(r)
    model = Whitening(n, model.sums, components, sizes**2 / n)
    return filled, Whitening(n, model.sums, components, model.eigenvalues, identity_error(listed, model, width, most)), width


def identity_error(listed: DataFrame, model: Whitening, width: int, most: int) -> float:
    """The largest entry, in size, of the whitened fit list's covariance less the identity, measured over all of it."""
    keep = model.positive(most)
    k = int(keep.sum())
    if not k:
        return 0.0

    def moments(state: np.ndarray, column: pa.Array) -> np.ndarray:
        w = model.whitened(whole_rows(column, width), most)[:, keep]
        mean = w.mean(axis=0)
        return merge([state, np.concatenate(([len(w)], mean, ((w - mean).T @ (w - mean)).ravel()))])

    def merge(found: list[np.ndarray]) -> np.ndarray:
        """Counts, means and centred products of several parts as those of their union."""
        total = np.zeros(1 + k + k * k)
        for f in found:
            n, m = total[0], f[0]
            if m:
                d = f[1 : 1 + k] - total[1 : 1 + k]
                products = total[1 + k :] + f[1 + k :] + np.outer(d, d).ravel() * n * m / (n + m)
                total = np.concatenate(([n + m], total[1 : 1 + k] + d * m / (n + m), products))
        return total

    found = combined(listed.mapInArrow(_states(lambda: np.zeros(1 + k + k * k), moments), "place long, state binary"), merge)
    return float(np.abs(found[1 + k :].reshape(k, k) / found[0] - np.eye(k)).max())


def whiten(vectors: DataFrame, scale: int = 64, most: int = 16) -> DataFrame:
    """Whitened components of each usable row of vectors (vec_id, embedding): vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null or non-finite entry are left out. An entry c counts
    as floor(scale * c), and adding the same to all entries changes no result. The fit list holds
    each vector of such numbers once, so hot copies weigh no more than others. Of vectors of different lengths the shorter ones count as
    ending in zeros. There is one row for each of the first ``most`` components, or as many as
    vectors have entries; vectors without entries, and an empty table, give no rows. Where a
    component has no variance (one vector, equal columns) whitened is null and explained 0, and
    it doesn't count for identity_error. deviation is null where it doesn't fit a long, and
    entries over 2^50 after scaling count as 2^50. Null and repeated vec_ids are rows like any
    other, other columns are ignored, whatever their names. The fit list is written to the
    shared folder; ``clean_up`` removes it.
    """
    rows, model, width = fit(vectors, scale, most)
    k = min(most, width)
    explained = model.eigenvalues[:k] / (model.eigenvalues.sum() or 1.0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = whole_rows(batch.column("x"), width)
            m = len(x)
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            w = model.whitened(x, k).ravel()
            yield pa.record_batch(
                [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(w, mask=np.isnan(w)),
                    pa.array(np.tile(np.where(model.positive(k), explained, 0.0), m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(project, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
