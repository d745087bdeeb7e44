"""Whitening against NumPy's eigenvectors and exact Python integers."""

import math

import numpy as np
import pytest

from corpusmill.llm.whitening import Whitening, jacobi, whiten

NAN = float("nan")


def brute(rows, most=16):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for _, v in kept]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object).reshape(-1, width)
    n, sums = len(fit), fit.sum(axis=0) if len(fit) else []
    centred = np.array(fit * n - sums, float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    out = []
    for (i, _), own in zip(kept, x, strict=True):
        deviation = sum((n * a - s) ** 2 for a, s in zip(own, sums, strict=True))
        y = np.array([n * a - s for a, s in zip(own, sums, strict=True)], float) / n
        out += [(i, k + 1, n, deviation, y @ v[:, -1 - k] / math.sqrt(e[-1 - k]) if e[-1 - k] > 1e-9 * e[-1] else None, e[-1 - k] / e.sum() if e.sum() else 0.0) for k in range(min(most, width))]
    return out


def check(spark, rows, kind="float"):
    if kind == "float":
        rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], f"vec_id long, embedding array<{kind}>, x string, n double")
    got = sorted(map(tuple, whiten(df).collect()), key=str)
    wanted = sorted(brute(rows), key=str)
    assert len(got) == len(wanted)
    key = lambda r: (-1 if r[0] is None else r[0], r[3], r[1])
    got, wanted = sorted(got, key=key), sorted(wanted, key=key)
    signs = {}
    for g, w in zip(got, wanted, strict=True):
        assert g[:4] == w[:4]
        assert (g[4] is None) == (w[4] is None)
        if w[4] is not None and abs(w[4]) > 1e-6:
            sign = signs.setdefault(g[1], math.copysign(1, g[4] * w[4]))
            assert abs(g[4] - sign * w[4]) < 1e-7 * max(1, abs(w[4]))
        assert abs(g[5] - w[5]) <= 1e-9 * max(w[5], 1e-12) + 1e-13
        assert g[6] <= 1e-9
    return got


def vectors(seed, n, width):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, width)) * np.geomspace(1, 0.05, width) @ np.linalg.qr(rng.standard_normal((width, width)))[0]


@pytest.mark.parametrize(("n", "width"), [(400, 24), (300, 5), (200, 1), (150, 17)])
def test_against_eigenvectors(spark, n, width):
    rows = list(enumerate(vectors(n, n, width).tolist()))
    assert len(check(spark, rows)) == n * min(16, width)


def test_copies_weigh_once_and_odd_rows_go(spark):
    rows = list(enumerate(vectors(1, 120, 6).tolist()))
    rows += [(1000 + k, rows[3][1]) for k in range(200)] + [(None, rows[5][1]), (7, rows[7][1])]
    rows += [(2000, None), (2001, [1.0, None] * 3), (2002, [NAN] * 6), (2003, [float("inf")] * 6), (2004, [-float("inf")] + [0.0] * 5), (2005, [0.25, 0.5])]
    got = check(spark, rows)
    assert got[0][2] == 121 and len(got) == (120 + 203) * 6


def test_no_variance(spark):
    rows = [(1, [0.5, 1.0]), (2, [0.5, 2.0]), (3, [0.5, 4.0])]  # the second component has none
    got = check(spark, rows)
    assert [r[4] is None for r in got] == [False, True] * 3
    assert {r[4] for r in check(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])} == {None}


def test_empty_tables(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [NAN])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert whiten(df).count() == 0


def test_deviations_stay_exact_and_never_wrap(spark):
    rows = [(k, [float(k) * 3e4, 1.0]) for k in range(30)]
    check(spark, rows, "double")
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0])], "vec_id long, embedding array<double>")
    assert {(r.deviation, round(abs(r.whitened or 0), 6)) for r in whiten(huge).collect()} == {(None, 1.0), (None, 0.0)}
    model = Whitening(3, [7, -2], np.eye(2), np.ones(2))
    assert model.deviations(np.array([[5, 1], [1 << 50, 0]])) == [8**2 + 5**2, None]


def test_jacobi_is_accurate_for_small_values():
    rng = np.random.default_rng(3)
    q, p = (np.linalg.qr(rng.standard_normal((20, 20)))[0] for _ in range(2))
    wanted = np.geomspace(1e3, 1e-4, 20)
    sizes, v = jacobi(np.linalg.qr(q * wanted @ p.T, mode="r"))
    assert np.allclose(sizes, wanted, rtol=1e-7) and np.allclose(v.T @ v, np.eye(20), atol=1e-13)
    assert np.allclose(np.abs((v * p).sum(axis=0)), 1, atol=1e-7)
    assert jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
