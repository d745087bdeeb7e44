import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm.components import merged
from corpusmill.llm.vector_dedup import vector_groups


def brute(rows):
    usable = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) for _, v in rows]
    width = max((len(v) for (_, v), ok in zip(rows, usable, strict=True) if ok), default=1)
    x = np.array([list(np.array(v, np.float32)) + [0] * (width - len(v)) if ok else [0] * width for (_, v), ok in zip(rows, usable, strict=True)], float)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.where(size == 0, 1, size)
    close = (x @ x.T >= 0.95) & np.array(usable)[:, None] & np.array(usable)[None, :]
    np.fill_diagonal(close, False)
    labels = merged(np.arange(len(rows)), *np.nonzero(close))
    return {rows[k][0]: (int(close[k].sum()), rows[labels[k]][0], bool(labels[k] == k)) for k in range(len(rows))}


def check(spark, rows, **sizes):
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = {r[0]: tuple(r[1:]) for r in vector_groups(df, **sizes).collect()}
    assert got == brute(rows)


def test_odd_vectors(spark):
    check(spark, [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0]), (10, [float("inf"), 1.0]), (11, [1e-30, 2e-30])])


@pytest.mark.parametrize("sizes", [{"leaf": 40}, {"leaf": 40, "branch_bytes": 60 * 32 * 8}, {"leaf": 40, "branch_bytes": 16 * 32 * 8}])
def test_clusters_and_borderline_pairs(spark, sizes):
    rng, rows = np.random.default_rng(2), []
    for _ in range(250):
        a = rng.standard_normal(32)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(32)
        b -= b @ a * a
        c = rng.uniform(0.94, 0.97)
        rows += [a, c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)]
    centre = rng.standard_normal(32)
    rows += [centre + 0.08 * rng.standard_normal(32) for _ in range(200)] + [centre] * 50
    check(spark, [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rows)], **sizes)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_groups(df).count() == 0
    assert vector_groups(df.select("vec_id", F.col("embedding").cast("array<double>"))).count() == 0


def test_recall_at_table_size(spark):
    """The table's vectors and pairs planted at cosines of 0.95 to 0.97, through deep trees: leaves of few rows, fitted on one in five."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").toPandas()["embedding"].tolist()
    rng, rows = np.random.default_rng(5), [list(map(float, v)) for v in table]
    for v in rng.standard_normal((2000, 64)):
        a = v / np.linalg.norm(v)
        b = rng.standard_normal(64)
        b -= b @ a * a
        c = rng.uniform(0.951, 0.97)
        rows += [a.tolist(), (c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist()]
    df = spark.createDataFrame([(i, v, "x", [1]) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, leaves string, vector array<int>")
    wanted = brute(list(enumerate(rows)))
    got = {r.vec_id: r.n_links for r in vector_groups(df, leaf=16, sample_rows=1200).collect()}
    links = sum(n for n, _, _ in wanted.values())
    assert all(got[i] <= wanted[i][0] for i in got) and links >= 4000
    assert sum(got.values()) >= 0.99 * links
