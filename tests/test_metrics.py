import math

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import metrics


def test_bits_per_byte(spark):
    n = math.log(3)
    scores = spark.createDataFrame([(0, 1, n, 1.0), (0, 2, n, 1.0), (1, 0, n, 1.0), (1, 2, n, 1.0)], "row int, label int, nll double, loss_mask double")
    sizes = spark.createDataFrame([(0, 0), (1, 1), (2, 3)], "token_id int, n_bytes int")
    got = {r.row: r for r in metrics.bits_per_byte(scores, sizes, ("row",)).collect()}
    assert got[0].nats == pytest.approx(2 * n) and got[0].n_bytes == 4 and got[0].bpb == pytest.approx(n / (2 * math.log(2)))
    assert got[1].nats == pytest.approx(n) and got[1].n_bytes == 3


def test_benchmark_scores(spark):
    items = spark.createDataFrame([("toy", True), ("toy", False), ("new", True)], "task string, correct boolean")
    base = spark.createDataFrame([("toy", 50.0)], "task string, baseline double")
    assert {(r.task, r.centered) for r in metrics.centered_scores(items, base).collect()} == {("toy", 0.0), ("new", 1.0)}
    options = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (2, 0, None), (2, 1, 9.0)], "item int, option int, loss double")
    assert {tuple(r) for r in metrics.best_option(options, ("item",)).collect()} == {(1, 0), (2, 1)}


@pytest.mark.parametrize(("step", "least", "wanted"), [(10, 0.0, 0.0), (0, 0.2, 0.5), (2, 0.2, 1.0), (7, 0.2, 0.68), (10, 0.2, 0.2)])
def test_schedule(spark, step, least, wanted):
    got = spark.range(1).select(metrics.stable_decay_schedule(F.lit(step), 2, 10, 3, least)).first()[0]
    assert got == pytest.approx(wanted)


def test_objective(spark):
    df = spark.createDataFrame([(1.0, math.e, 0.5), (float("nan"), 1.0, 0.0), (-1.0, 1.0, 0.0)], "a double, b double, c double")
    assert [round(r[0], 6) for r in df.select(metrics.objective(F.col("a"), F.col("b"), F.col("c"))).collect()] == [1 - 0.03 + 0.1, 1e9, 1e9]


def test_prefixes(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 4, 3]), ([], [1]), ([1], [1])], "a array<int>, b array<int>")
    assert [tuple(r) for r in df.select(metrics.common_prefix(F.col("a"), F.col("b")), metrics.common_suffix(F.col("a"), F.col("b"))).collect()] == [(2, 1), (0, 0), (1, 1)]


def test_filters(spark):
    df = spark.createDataFrame([([2.0, 1.0, 0.0, -5.0],)], "x array<double>")
    r = df.select(metrics.filtered_logits(F.col("x"), top_k=2), metrics.filtered_logits(F.col("x"), top_p=0.95), metrics.filtered_logits(F.col("x"), top_p=0.01)).first()
    assert r[0] == [2.0, 1.0, None, None] and r[1] == [2.0, 1.0, None, None] and r[2] == [2.0, None, None, None]
