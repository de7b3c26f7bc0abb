import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridgeline.functions import families as fm
from ridgeline.functions.links import LINKS
from ridgeline.functions.ops import NP, SP
from ridgeline.functions.special import digamma, lgamma, norm_cdf, norm_ppf, sigmoid, sigmoid_slope, softplus, trigamma

FAMILIES = [fm.Gaussian(), fm.Binomial(), fm.Poisson(), fm.Gamma(link_name="log"), fm.InverseGaussian(), fm.Tweedie(p=1.4), fm.NegBin(theta=3.0), fm.QuasiPoisson(), fm.QuasiBinomial(), fm.StudentT(nu=4.0), fm.Quantile(tau=0.7, sigma=0.5, co=0.3), fm.OrderedCategorical(theta=(0.2, 0.1))]


def sample(fam, n=200):
    rng = np.random.default_rng(3)
    if fam.name == "ocat":
        return rng.integers(1, 5, n).astype(float)
    if "binomial" in fam.name:
        return rng.integers(0, 2, n).astype(float)
    return rng.gamma(2.0, 1.0, n) if fam.positive else rng.normal(0, 1, n)


@given(st.floats(1e-3, 1e4))
@settings(deadline=None, max_examples=100)
def test_lgamma_agrees(x):
    assert float(lgamma(NP, np.float64(x))) == pytest.approx(math.lgamma(x), rel=1e-11, abs=1e-11)


def test_gamma_derivatives():
    x = np.array([0.1, 0.7, 3.0, 50.0])
    h = 1e-5
    assert np.allclose((lgamma(NP, x + h) - lgamma(NP, x - h)) / (2 * h), digamma(x), rtol=1e-6)
    assert np.allclose((digamma(x + h) - digamma(x - h)) / (2 * h), trigamma(x), rtol=1e-6)


def test_normal_functions():
    for p in (1e-9, 0.025, 0.5, 0.975, 1 - 1e-9):
        assert float(norm_cdf(norm_ppf(p))) == pytest.approx(p, rel=1e-9)
    assert norm_ppf(0.975) == pytest.approx(1.959963984540054, abs=1e-13)


def test_sigmoid_tails():
    x = np.array([-800.0, -30.0, 0.0, 30.0, 800.0])
    assert np.isfinite(sigmoid(NP, x)).all() and np.isfinite(softplus(NP, x)).all()
    assert sigmoid_slope(NP, np.array([40.0]))[0] == pytest.approx(math.exp(-40), rel=1e-12)


@pytest.mark.parametrize("name", ["identity", "log", "logit", "inverse"])
def test_links_invert_and_differentiate(name):
    link, eta = LINKS[name], np.array([-3.0, -0.4, 0.3, 2.5])
    mu = link.inverse(NP, eta)
    if name != "inverse":
        assert np.allclose(link.link(NP, mu), eta)
    h = 1e-6
    assert np.allclose((link.inverse(NP, eta + h) - link.inverse(NP, eta - h)) / (2 * h), link.slope(NP, eta), rtol=1e-6)
    mu = np.array([0.2, 0.5, 0.8])
    g1 = lambda m: 1 / link.slope(NP, link.link(NP, m))
    assert np.allclose((g1(mu + h) - g1(mu - h)) / (2 * h), link.derivatives(NP, mu)[0], rtol=1e-5, atol=1e-6)
    for i in (0, 1):
        assert np.allclose((link.derivatives(NP, mu + h)[i] - link.derivatives(NP, mu - h)[i]) / (2 * h), link.derivatives(NP, mu)[i + 1], rtol=1e-5, atol=1e-6)


def test_links_stay_finite():
    for link in LINKS.values():
        assert np.isfinite(link.inverse(NP, np.array([-1e6, 0.0, 1e6]))).all()


@pytest.mark.parametrize("fam", FAMILIES, ids=lambda f: f.name)
def test_score_is_the_deviance_slope(fam):
    y, eta, h = sample(fam), np.linspace(-1.5, 1.5, 200), 1e-6
    d = (fam.deviance_eta(NP, y, eta + h) - fam.deviance_eta(NP, y, eta - h)) / (2 * h)
    w, g = fam.working(NP, y, eta)
    assert np.allclose(g, -0.5 * d, rtol=1e-4, atol=1e-5)
    assert (w > 0).all()


@pytest.mark.parametrize("fam", FAMILIES, ids=lambda f: f.name)
def test_columns_agree_with_numpy(spark, fam):
    y, eta = sample(fam, 40), np.linspace(-2, 2, 40)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, eta)], "y double, eta double")
    w, g = fam.working(SP, F.col("y"), F.col("eta"))
    got = df.select("y", "eta", fam.deviance_eta(SP, F.col("y"), F.col("eta")).alias("d"), w.alias("w"), g.alias("g")).toPandas()
    wn, gn = fam.working(NP, got["y"].to_numpy(), got["eta"].to_numpy())
    assert np.allclose(got["d"], fam.deviance_eta(NP, got["y"].to_numpy(), got["eta"].to_numpy()), rtol=1e-10, atol=1e-10)
    assert np.allclose(got["w"], wn, rtol=1e-10) and np.allclose(got["g"], gn, rtol=1e-10, atol=1e-10)


def test_probabilities_sum_to_one():
    fam = fm.OrderedCategorical(theta=(0.2, 0.1, -0.5))
    p = sum(fam.probability(NP, np.linspace(-5, 5, 50), r) for r in range(1, fam.classes + 1))
    assert np.allclose(p, 1)


def test_smoothed_check_loss_is_a_density():
    fam = fm.Quantile(tau=0.8, sigma=0.4, co=0.3)
    y = np.linspace(-30, 30, 600_001)
    like = np.exp(fam.saturated(1.0, 1, np.array([1.0])) - 0.5 * fam.deviance(NP, y, 0.0))
    assert np.sum(like) * (y[1] - y[0]) == pytest.approx(1, rel=1e-3)


def test_tweedie_density_sums_to_one():
    fam = fm.Tweedie(p=1.5)
    phi, mu = 0.8, 1.3
    y = np.linspace(1e-4, 40, 40_000)
    density = np.exp(fam.log_density_at_y(y, phi) - 0.5 * fam.deviance(NP, y, mu) / phi)
    zero = math.exp(-0.5 * float(fam.deviance(NP, np.zeros(1), np.array([mu]))[0]) / phi)
    assert density.sum() * (y[1] - y[0]) + zero == pytest.approx(1, abs=2e-3)


def test_family_names_and_refusals():
    assert fm.family("nb").name == "negbin" and fm.family("ocat(4)").classes == 4 and fm.family("gamma", "log").link_name == "log"
    for bad in (("no",), ("poisson", "logit")):
        with pytest.raises(ValueError):
            fm.family(*bad)
    with pytest.raises(ValueError):
        fm.family("tweedie", p=2.5)
