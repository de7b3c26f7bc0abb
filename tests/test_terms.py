import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import linalg
from ridgeline.operators.terms import BSpline, Cubic, Linear, RandomEffect, ThinPlate, quantile_knots, restored

X = np.linspace(-0.5, 1.5, 101)


def made(kind):
    t = {"cr": lambda: Cubic("x", 6, knots=np.array([0, 0.1, 0.3, 0.6, 0.9, 1.0])), "bs": lambda: BSpline("x", 8, lo=0.0, hi=1.0), "tps": lambda: ThinPlate("x", 5, knots=np.array([0.2, 0.5, 0.8]))}[kind]()
    b = t.basis(np.linspace(0, 1, 50))
    t.prepare(b.sum(0), 50, np.abs(b).sum(1).max())
    return t


@pytest.mark.parametrize("kind", ["cr", "bs"])
def test_basis_sums_to_one_inside(kind):
    assert np.allclose(made(kind).basis(np.linspace(0, 1, 30)).sum(1), 1)


@pytest.mark.parametrize("kind", ["cr", "bs", "tps"])
def test_column_agrees_with_kernel(spark, kind):
    t = made(kind)
    beta = np.random.default_rng(1).normal(size=t.size)
    got = spark.createDataFrame([(float(v),) for v in X], "x double").select("x", t.column(F.col("x"), beta).alias("f")).toPandas()
    assert np.allclose(got["f"], t.block(got["x"].to_numpy()) @ beta, rtol=1e-10, atol=1e-11)


@pytest.mark.parametrize("kind", ["cr", "bs"])
def test_linear_beyond_the_ends(kind):
    b = made(kind).basis(np.array([1.5, 2.0, 2.5]))
    assert np.allclose(b[2] - b[1], b[1] - b[0])


def test_cubic_interpolates():
    t = made("cr")
    assert np.allclose(t.basis(t.knots), np.eye(6))


@pytest.mark.parametrize("kind", ["cr", "bs"])
def test_penalty_is_the_curvature_integral(kind):
    t = made(kind)
    lo, hi = t.breaks()[0], t.breaks()[-1]
    x, h = np.linspace(lo, hi, 20_001), 1e-4
    inner = x[(x > lo + h) & (x < hi - h)]
    d2 = (t.basis(inner + h) - 2 * t.basis(inner) + t.basis(inner - h)) / h**2
    s = d2.T @ d2 * (x[1] - x[0])
    assert np.allclose(s, t.penalty(), rtol=2e-2, atol=2e-2 * np.abs(s).max())


def test_constraints():
    t = made("cr")
    assert np.allclose(t.block(np.linspace(0, 1, 50)).sum(0), 0, atol=1e-10)
    p = Cubic("x", 6, pc=0.4, knots=t.knots)
    p.prepare(np.zeros(6), 1, 1.0)
    assert np.allclose(p.block(np.array([0.4])), 0, atol=1e-12)


def test_levels(spark):
    t = RandomEffect("g", levels=["a", "b"])
    t.prepare(np.zeros(0), 1, 1.0)
    assert t.block(np.array(["b", "?"], dtype=object)).tolist() == [[0, 1], [0, 0]]
    got = spark.createDataFrame([("a",), ("?",), (None,)], "g string").select(t.column(F.col("g"), np.array([2.0, 3.0])).alias("f")).toPandas()
    assert got["f"].tolist() == [2.0, 0.0, 0.0]


def test_knots_at_quantiles_of_distinct_values():
    assert quantile_knots(np.array([1, 1, 1, 2, 3, 4, 5.0]), 3).tolist() == [1, 3, 5]
    assert len(quantile_knots(np.array([1.0, 2.0]), 5)) == 5


def test_state_survives_json():
    for t in (made("cr"), made("bs"), made("tps")):
        again = restored(json.loads(json.dumps(t.state())))
        assert np.allclose(again.block(X), t.block(X))
    assert restored(Linear("z").state()).name == "z"


def test_linear_algebra():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(8, 8))
    a = a @ a.T + np.eye(8)
    b = rng.normal(size=(8, 2))
    assert np.allclose(linalg.solve(a, b), np.linalg.solve(a, b))
    l, piv, rank = linalg.pivoted_cholesky(a)
    assert rank == 8 and np.allclose(l @ l.T, a[np.ix_(piv, piv)])
    assert linalg.pivoted_cholesky(np.ones((3, 3)))[2] == 1
    assert linalg.logdet(a) == pytest.approx(np.linalg.slogdet(a)[1])
    s = np.diag([0.0, 2.0, 3.0])
    assert linalg.rank_and_logdet(s) == (2, pytest.approx(np.log(6)))
    assert np.allclose(linalg.root(s) @ linalg.root(s).T, s)
    x = rng.normal(size=(60, 5))
    r = linalg.stacked_r([x[:20], x[20:]])
    assert np.allclose(r.T @ r, x.T @ x)
    assert linalg.brent(lambda v: (v - 1.3) ** 2, -4, 6)[0] == pytest.approx(1.3, abs=1e-6)
    assert np.allclose(linalg.bfgs(lambda v: ((v - [1, 2]) ** 2 * [1, 20]).sum(), np.zeros(2))[0], [1, 2], atol=1e-4)
