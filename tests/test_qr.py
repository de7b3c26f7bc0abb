"""Fits by merged triangular factors: designs on which X'WX loses digits, and agreement with it elsewhere."""

import numpy as np
import pandas as pd
import pytest

from ridgeline.operators import rows as rows_module
from ridgeline.operators.fit import Options, fit_gam
from ridgeline.operators.terms import Cubic, Linear


@pytest.fixture(scope="module")
def alike(spark):
    """b is a, but for a millionth."""
    rng = np.random.default_rng(3)
    a, u = rng.normal(size=(2, 3000))
    return spark.createDataFrame(pd.DataFrame({"a": a, "b": a + 1e-6 * u})).repartition(6).selectExpr("a", "b", "1 + 2 * a + 3 * b AS y").cache()


@pytest.mark.parametrize("local_rows,direct", [(200_000, 256), (10, 256), (10, 2)])
def test_columns_alike_are_told_apart(alike, monkeypatch, local_rows, direct):
    monkeypatch.setattr(rows_module, "DIRECT", direct)  # 2: factors are merged on executors first
    terms = lambda: [Linear("a"), Linear("b")]
    by_factor = fit_gam(alike, "y", terms(), opt=Options(local_rows=local_rows, qr=True)).beta
    assert by_factor == pytest.approx([1, 2, 3], abs=1e-8)
    assert np.abs(fit_gam(alike, "y", terms(), opt=Options(local_rows=local_rows)).beta - [1, 2, 3]).max() > 1e-6  # by X'WX


@pytest.fixture(scope="module")
def plain(spark):
    rng = np.random.default_rng(5)
    x, z = rng.random((2, 1500))
    eta = np.sin(5 * x) + z
    df = pd.DataFrame({"x": x, "z": z, "normal": eta + 0.3 * rng.normal(size=1500), "count": rng.poisson(np.exp(eta)).astype(float), "hit": (rng.random(1500) < 1 / (1 + np.exp(-eta))).astype(float)})
    return spark.createDataFrame(df).cache()


@pytest.mark.parametrize("fam,y,method", [("gaussian", "normal", "REML"), ("gaussian", "normal", "GCV"), ("gaussian", "normal", "fREML"), ("poisson", "count", "fREML"), ("binomial", "hit", "REML")])
def test_both_ways_agree(plain, fam, y, method):
    a, b = (fit_gam(plain, y, [Cubic("x", 8), Linear("z")], fam, opt=Options(method=method, qr=q)) for q in (False, True))
    assert b.lam == pytest.approx(a.lam, rel=1e-3)
    assert b.beta == pytest.approx(a.beta, abs=1e-4) and b.edf == pytest.approx(a.edf, abs=1e-4)
    assert b.vcov == pytest.approx(a.vcov, rel=1e-3, abs=1e-6) and b.score_value == pytest.approx(a.score_value, rel=1e-6)


def test_fewer_rows_than_columns_and_columns_that_repeat(spark):
    df = spark.createDataFrame([(float(i), float(i), 2.0 * i) for i in range(5)], "a double, b double, y double")
    m = fit_gam(df, "y", [Linear("a"), Linear("b")], opt=Options(qr=True))
    assert m.transform(df).toPandas()["prediction"].to_numpy() == pytest.approx(2.0 * np.arange(5), abs=1e-9)
