import numpy as np
import pytest

from corpusmill.operators.skyline import beaten_by_earlier, local_front, pareto_front

NAN = float("nan")
SCHEMA = "trial long, loss_mean double, stability_mean double, speed_mean double, x string"


def brute(rows):
    """Trials that no other beats; nan is the worst, and those with a null are not compared."""
    known = [(r[0], *(np.inf if g != g else g for g in (r[1], r[2], -r[3] if r[3] == r[3] else NAN))) for r in rows if None not in r[1:4]]
    beaten = {a[0] for a in known for b in known if b[1:] != a[1:] and all(q <= p for p, q in zip(a[1:], b[1:], strict=True))}
    return {r[0] for r in rows} - beaten


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_fronts_with_ties(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(i, float(i % 13), float(i % 7), float(i % 5), "a") for i in range(60)]
    rows += [(100 + i, *map(float, rng.integers(0, 6, 3)), "b") for i in range(150)]
    rows += [(300 + i, float(a), float(-a), 0.0, "c") for i, a in enumerate(rng.integers(-20, 20, 60))]  # ties of one goal, all on a line
    rows += [(500, None, 0.0, 1.0, "n"), (501, NAN, 0.0, 99.0, "n"), (502, 0.0, 0.0, NAN, "n"), (503, -0.0, 0.0, 4.0, "z"), (504, 0.0, -0.0, 4.0, "z"), (505, float("inf"), 1.0, float("-inf"), "i")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = pareto_front(df, parts=parts)
    assert got.columns == df.columns and sorted(r.trial for r in got.collect()) == sorted(brute(rows))


def test_fewer_goals_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0, 0.0, ""), (2, 2.0, 4.0, 0.0, ""), (3, 2.0, 5.0, 9.0, "")], SCHEMA)
    assert {r.trial for r in pareto_front(df, ("loss_mean", "stability_mean"), ()).collect()} == {1, 2}
    assert {r.trial for r in pareto_front(df, (), ("speed_mean",)).collect()} == {3}
    assert pareto_front(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="three"):
        pareto_front(df, ("loss_mean",) * 4)


def test_large_front_without_a_nested_loop(spark):
    """300,000 trials of which most are on the front."""
    df = spark.range(300_000).selectExpr("id AS trial", "cast(id as double) AS loss_mean", "cast(-id + pmod(hash(id), 7) as double) AS stability_mean", "cast(pmod(hash(id, 1), 1000) as double) AS speed_mean", "'' AS x")
    found = pareto_front(df)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.toPandas()
    rows = df.toPandas()
    assert len(got) > 100_000
    front = local_front(rows.loss_mean.to_numpy(), rows.stability_mean.to_numpy(), -rows.speed_mean.to_numpy())
    assert sorted(got.trial) == sorted(rows.trial.to_numpy()[front])


def test_sweeps():
    rng = np.random.default_rng(2)
    for _ in range(30):
        points = np.unique(rng.integers(0, 5, (40, 3)), axis=0).astype(float)
        front = local_front(*points.T)
        assert sorted(front) == [i for i, a in enumerate(points) if not any((b <= a).all() and (b != a).any() for b in points)]
        part, y, z = rng.integers(0, 4, 40), *rng.integers(0, 5, (2, 40)).astype(float)
        assert beaten_by_earlier(part, y, z).tolist() == [any(part[j] < part[i] and y[j] <= y[i] and z[j] <= z[i] for j in range(40)) for i in range(40)]
