import json
import math
import os
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline.api import GAM, Gam, Options, grouped_fit
from ridgeline.functions.families import family
from ridgeline.operators import select
from ridgeline.operators import fit as fitting
from ridgeline.operators.fit import TARGET, WEIGHT, Design, ExactScore, Statistics, fit_gam, pirls, reml_at, reml_derivatives
from ridgeline.operators.model import GamModel
from ridgeline.operators.rows import LocalRows, SparkRows
from ridgeline.operators.terms import BSpline, Cubic, Linear, RandomEffect
from ridgeline.sources.formula import parse
from ridgeline.sources.frames import ingest, ranges, read, with_response
from ridgeline.sources.store import artefact_frame, load, save


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 1500
    x, z, g = rng.random(n), rng.random(n), rng.integers(0, 5, n)
    eta = np.sin(6 * x) + 0.5 * z
    cols = {
        "id": np.arange(n), "x": x, "z": z, "g": [f"g{i}" for i in g], "gauss": eta + 0.2 * g + rng.normal(0, 0.3, n), "binom": (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float), "pois": rng.poisson(np.exp(eta)).astype(float),
        "gam": rng.gamma(2, np.exp(eta) / 2), "ig": np.maximum(rng.wald(np.exp(eta), 3.0), 1e-3), "nb": rng.negative_binomial(3, 3 / (3 + np.exp(eta))).astype(float), "tw": np.where(rng.random(n) < 0.3, 0, rng.gamma(2, np.exp(eta) / 2)),
        "t": eta + rng.standard_t(4, n) * 0.3, "w": rng.integers(1, 4, n).astype(float),
    }
    lat = eta + rng.logistic(size=n)
    cols["cat"] = 1.0 + (lat > -1) + (lat > 0.5) + (lat > 1.5)
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(cols)).cache(), eta


def smooths():
    return [Cubic("x", 10), BSpline("z", 6)]


def test_published_fit(spark):
    with open(os.path.join(os.path.dirname(__file__), "golden_cubic.json")) as f:
        d = json.load(f)
    df = spark.createDataFrame(list(zip(d["x"], d["y"])), "x double, y double")
    m = fit_gam(df, "y", [Cubic("x", 10)])
    assert m.lam[0] == pytest.approx(d["lambda"][0], rel=1e-6)
    assert (m.edf_total, m.scale, m.deviance, m.score_value) == (pytest.approx(d["edf"], abs=1e-7), pytest.approx(d["scale"], rel=1e-8), pytest.approx(d["deviance"], rel=1e-7), pytest.approx(d["score"], abs=1e-8))
    assert np.allclose((m.design({"x": np.array(d["x"])}) @ m.beta)[:10], d["prediction"], atol=1e-8)
    assert np.allclose(m.design({"x": np.array(d["x_new"])}) @ m.beta, d["prediction_new"], atol=1e-7)


@pytest.mark.parametrize("name,target,link", [("gaussian", "gauss", None), ("binomial", "binom", None), ("quasibinomial", "binom", None), ("poisson", "pois", None), ("quasipoisson", "pois", None), ("gamma", "gam", "log"),
                                              ("inverse.gaussian", "ig", None), ("nb", "nb", None), ("tweedie", "tw", None), ("scat", "t", None), ("ocat(4)", "cat", None)])
def test_families_recover_the_predictor(data, name, target, link):
    df, eta = data
    m = fit_gam(df, target, smooths(), family(name, link), opt=Options(method="fREML"))
    got = m.transform(df, "link").orderBy("id").toPandas()["prediction"].to_numpy()
    assert np.corrcoef(got, eta)[0, 1] > 0.93
    assert 3 < m.edf_total < 16 and np.isfinite(m.vcov).all() and (np.linalg.eigvalsh(m.vcov) > -1e-9).all()


def test_exact_score_is_no_worse(data):
    df, _ = data
    exact, quick = fit_gam(df, "pois", smooths(), "poisson"), fit_gam(df, "pois", smooths(), "poisson", opt=Options(method="fREML"))
    assert exact.score_value <= quick.score_value + 40 and abs(exact.edf_total - quick.edf_total) < 1


def test_methods_agree_roughly(data):
    df, _ = data
    edf = [fit_gam(df, "gauss", smooths(), opt=o).edf_total for o in (Options(), Options(method="GCV"), Options(algorithm="fellner-schall"), Options(discrete=True))]
    assert max(edf) - min(edf) < 6


def test_weight_two_is_a_row_twice(data):
    df, _ = data
    twice = df.unionByName(df.where("w = 2")).where("w < 3")
    a = fit_gam(df.where("w < 3"), "gauss", [Cubic("x", 8)], weight="w", opt=Options(lam=[2.0]))
    b = fit_gam(twice, "gauss", [Cubic("x", 8)], opt=Options(lam=[2.0]))
    x = np.linspace(0, 1, 20)
    fa, fb = (m.design({"x": x}) @ m.beta for m in (a, b))
    assert np.allclose(fa, fb, atol=2e-3)


def test_driver_and_executors_agree(data):
    df, _ = data
    for fam, y in (("gaussian", "gauss"), ("poisson", "pois")):
        a, b = (fit_gam(df.repartition(7), y, smooths(), fam, opt=Options(lam=[3.0, 5.0], local_rows=n)) for n in (10**6, 0))
        assert np.allclose(a.beta, b.beta, atol=1e-9)


def test_random_and_linear_terms(data):
    df, _ = data
    m = fit_gam(df, "gauss", [Cubic("x", 10), Linear("z"), RandomEffect("g")])
    assert m.coef["z"][0] == pytest.approx(0.5, abs=0.1)
    assert np.corrcoef(m.coef["g"], np.arange(5))[0, 1] > 0.98


def test_scores_derivatives(data):
    df, _ = data
    m = fit_gam(df, "gauss", smooths(), opt=Options(lam=[4.0, 9.0]))
    g, h = reml_derivatives(m, [4.0, 9.0])
    e = 1e-5
    for i in range(2):
        up, down = np.log([4.0, 9.0]), np.log([4.0, 9.0])
        up[i] += e
        down[i] -= e
        assert g[i] == pytest.approx((reml_at(m, np.exp(up)) - reml_at(m, np.exp(down))) / (2 * e), abs=1e-5)
    assert np.allclose(h, h.T)
    w = select.Working(m.gram, m.rhs, m.zz, m.rows)
    assert select.grid(w, Design(m.terms).penalties) > 0


def test_model_views_terms_intervals(spark, data):
    df, _ = data
    m = fit_gam(df, "pois", smooths(), "poisson", opt=Options(method="fREML"))
    t = m.transform_terms(df).toPandas()
    assert np.allclose(t["f_x"] + t["f_z"] + t["intercept"], t["total"])
    assert np.allclose(np.exp(t["total"]), m.transform(df).toPandas()["prediction"], rtol=1e-9)
    assert abs(t["f_x"].sum()) < 1e-6 * len(t) + 1e-6
    only = m["x"]
    assert np.allclose(only.transform(df.select("id", "x"), "link").toPandas()["prediction"], t["f_x"])
    assert np.allclose(m[["x", "intercept"]].transform(df, "link").toPandas()["prediction"], t["f_x"] + m.intercept)
    with pytest.raises(KeyError):
        m["nope"]
    ci = m.transform_ci(df.select("id", "x", "z")).toPandas()
    drawn = m.transform_ci(df.select("id", "x", "z"), method="sample").toPandas()
    assert ((ci["lower"] <= ci["prediction"]) & (ci["prediction"] <= ci["upper"])).all()
    assert np.allclose(ci["upper"], drawn["upper"], rtol=0.2)
    d = m.diff(df.select("id", "x", "z"), df.select("id", "x", "z"), on="id").toPandas()
    assert np.allclose(d["diff"], 0) and np.allclose(d["se"], 0, atol=1e-9)
    one = m.diff(df.select("id", "x", "z"), df.where("id = 3").select("x", "z")).toPandas().set_index("id")
    assert one.loc[3, "diff"] == pytest.approx(0, abs=1e-12)
    assert m.partial_effect(spark, "x", 30).count() == 30
    assert m.posterior(df.limit(5).select("id", "x", "z"), 50).toPandas()["samples"].map(len).tolist() == [50] * 5


def test_inverse_link_bounds_in_order(data):
    df, _ = data
    m = fit_gam(df.withColumn("y", 1.0 / (1.0 + F.col("gam"))), "y", [Cubic("x", 6)], family("gamma"), opt=Options(method="fREML"))
    ci = m.transform_ci(df.select("x")).toPandas()
    assert (ci["lower"] <= ci["upper"]).all()


def test_persistence(spark, data, tmp_path):
    df, _ = data
    m = fit_gam(df, "gauss", [Cubic("x", 8), RandomEffect("g")])
    again = GamModel.from_json(m.to_json())
    assert again.check_against(m, df)
    save(m, spark, f"file://{tmp_path}/m")
    assert load(spark, f"file://{tmp_path}/m").check_against(m, df)
    a = m["x"].artefact(10)
    assert a["lp_matrix"].shape == (12, len(m.beta)) and a["predictors_info"]["x"] == [1, 7]
    assert artefact_frame(m, spark, 5).count() == 7


def test_summary_and_score(data):
    df, _ = data
    m = fit_gam(df, "gauss", smooths())
    pdf = m.transform(df).toPandas()
    r2 = 1 - ((pdf["gauss"] - pdf["prediction"]) ** 2).sum() / ((pdf["gauss"] - pdf["gauss"].mean()) ** 2).sum()
    assert m.score(df) == pytest.approx(r2, abs=1e-9)
    assert m.summary(df)["r2_adjusted"] < r2 and set(m.summary(df)["terms"]) == {"x", "z"}
    b = fit_gam(df, "binom", smooths(), "binomial", opt=Options(method="fREML"))
    p = b.probabilities(df).toPandas()
    assert np.allclose(p["p0"] + p["p1"], 1) and b.score(df) == pytest.approx(((p["p1"] >= 0.5) == (p["binom"] >= 0.5)).mean())


def test_estimators(spark, data):
    df, _ = data
    g = Gam(["x", "z"], k={"x": 8, "z": 5}, bs={"z": "bs"}, random=["g"], pc={"x": 0.3}).fit(df, "gauss")
    assert g.model.names == ["x", "z", "g"] and g.score(df) > 0.5
    assert abs(float(g.model.terms[0].block(np.array([0.3])) @ g.model.coef["x"])) < 1e-9
    auto = Gam(["x"], k=3, auto_k=True).fit(df, "t")
    assert auto.model.terms[0].k > 3 and auto.auto_k_trace
    f = GAM().fit_formula("gauss ~ s(x, k=8) + z + re(g)", df)
    assert [t.kind for t in f.terms] == ["cr", "parametric", "re"]
    assert GAM().fit_auto(df.select("x", "z", "gauss"), "gauss", k=[6, 5]).names == ["x", "z"]
    assert GAM().add_smooth("x", 6).fit_manual(df, "gauss", lam=[1.0]).lam.tolist() == [1.0]
    pdf = df.select("x", "z").limit(300).toPandas()
    assert Gam(k=5).fit(pdf.to_numpy(), pdf["x"].to_numpy() + 0.01 * pdf["z"].to_numpy()).predict(pdf.to_numpy()).count() == 300


def test_groups(spark, data):
    df, _ = data
    out = grouped_fit(df, "g", "gauss ~ s(x, k=6)").toPandas()
    assert len(out) == 5 and GamModel.from_json(out["model"][0]).names == ["x"]


def test_formula_refusals():
    assert [t.kind for t in parse("y ~ s(a, k=5, bs='bs') + b + re(c)")[1]] == ["bs", "parametric", "re"] and parse("s(a)")[0] is None
    for bad in ("y ~", "y ~ s()", "y ~ s(a, q=1)", "y ~ s(a, bs='zz')", "y ~ s(a", "y ~ a*b"):
        with pytest.raises(ValueError):
            parse(bad)


def test_bad_input_is_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, None, -1.0)], "x double, y double, w double")
    for kw in ({"target": "y"}, {"target": "x", "weight": "w"}, {"target": "nope"}):
        with pytest.raises(ValueError):
            fit_gam(df, terms=[Linear("x")], **kw)
    with pytest.raises(ValueError):
        fit_gam(df.limit(0), "y", [Linear("x")])


def test_nulls_can_be_left_out(spark):
    rows = [(float(i), float(i) * 2 + (i % 3)) for i in range(50)] + [(None, 1.0), (3.0, None), (float("nan"), 1.0)]
    m = fit_gam(spark.createDataFrame(rows, "x double, y double"), "y", [Linear("x")], opt=Options(na_action="omit"))
    assert m.rows == 50


def test_k_is_capped_with_a_warning(spark):
    df = spark.createDataFrame([(float(i % 5), float(i)) for i in range(40)], "x double, y double")
    with pytest.warns(UserWarning, match="set to 4"):
        assert fit_gam(df, "y", [Cubic("x", 10)]).terms[0].k == 4
    events = spark.createDataFrame([(float(i), float(i == 3)) for i in range(60)], "x double, y double")
    with pytest.warns(UserWarning, match="events"):
        with warnings.catch_warnings():
            warnings.simplefilter("always")
            fit_gam(events, "y", [Cubic("x", 6)], "binomial", opt=Options(lam=[1.0]))


def test_frames(spark, tmp_path):
    df = ingest(spark, np.arange(6.0).reshape(3, 2))
    assert df.columns == ["x0", "x1"] and ingest(spark, df, ["x1"]).columns == ["x1"]
    with pytest.raises(ValueError):
        ingest(spark, df, ["x9"])
    assert with_response(spark, np.arange(3.0), np.ones((3, 1))).columns == ["x0", "y"]
    with pytest.raises(ValueError):
        with_response(spark, np.arange(3.0), np.ones(2))
    df.write.parquet(f"{tmp_path}/a")
    assert read(spark, f"{tmp_path}/a", columns=["x0"]).columns == ["x0"]
    assert ranges(spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double"), ["v"]) == {"v": (1.0, 3.0)}


def test_distinct_values_in_spark_and_on_the_driver(data, monkeypatch):
    from ridgeline.operators import fit as module

    df, _ = data
    near = fit_gam(df, "gauss", [Cubic("x", 7)], opt=Options(lam=[1.0]))
    far = fit_gam(df, "gauss", [Cubic("x", 7)], opt=Options(lam=[1.0], local_rows=0))
    assert np.allclose(near.terms[0].knots, far.terms[0].knots, atol=1e-12)
    monkeypatch.setattr(module, "EXACT_DISTINCT", 10)
    for accuracy in (100_000, 50):  # the second brackets 1500 values by ranks off by 30
        monkeypatch.setattr(module, "ACCURACY", accuracy)
        wide = fit_gam(df, "gauss", [Cubic("x", 7)], opt=Options(lam=[1.0], local_rows=0))
        assert np.allclose(near.terms[0].knots, wide.terms[0].knots, atol=1e-12)
    monkeypatch.undo()
    binned = [fit_gam(df.union(df), "gauss", [Cubic("x", 7)], opt=Options(lam=[1.0], discrete=True, local_rows=n)) for n in (0, 10**6)]
    assert np.allclose(binned[0].beta, binned[1].beta, atol=1e-8)


def test_tweedie_power_is_profiled(data):
    df, _ = data
    free = Gam(["x"], family="tweedie").fit(df, "tw").model.fam.p
    assert free != 1.5 and Gam(["x"], family="tweedie", p=1.5).fit(df, "tw").model.fam.p == 1.5


def test_shapes_are_refined_between_grid_values(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"x": rng.random(3000)})
    pdf["y"] = pdf["x"] + 0.3 * rng.standard_t(5, 3000)
    nu = fit_gam(spark.createDataFrame(pdf), "y", [Linear("x")], "scat").fam.nu
    grid = np.exp(np.linspace(math.log(2.0), math.log(100.0), 33))
    assert np.abs(grid / nu - 1).min() > 1e-4 and 4 < nu < 6.5


def test_tweedie_power_lies_between_grid_values(spark):
    rng = np.random.default_rng(9)
    n, mu, phi, p = 2500, 3.0, 1.2, 1.62
    counts = rng.poisson(mu ** (2 - p) / (phi * (2 - p)), n)
    shape, scale = (2 - p) / (p - 1), phi * (p - 1) * mu ** (p - 1)
    pdf = pd.DataFrame({"x": rng.random(n), "y": [rng.gamma(shape * c, scale) if c else 0.0 for c in counts]})
    found = fit_gam(spark.createDataFrame(pdf), "y", [Linear("x")], "tweedie", opt=Options(profile_p=True)).fam.p
    assert abs(found - p) < 0.06 and min(abs(found - q) for q in np.linspace(1.05, 1.95, 19)) > 1e-4


def test_cells_equal_binned_rows(data):
    """Sums by cell give the fit that the binned rows themselves give: smooths, a random effect, a linear column in no cell, one that
    is in cells too, weights, and two smooths of one column."""
    df, _ = data
    df = df.unionByName(df.withColumn("x", F.col("x") * 0.9 + 0.01))
    terms = lambda: [Cubic("x", 8), Linear("z"), BSpline("z", 6), RandomEffect("g"), Linear("w"), BSpline("x", 5)]
    for weight in (None, "w"):
        near, far = (fit_gam(df, "gauss", terms(), weight=weight, opt=Options(lam=[2.0, 3.0, 1.0, 4.0], discrete=True, local_rows=n)) for n in (10**6, 0))
        assert np.allclose(near.gram, far.gram, rtol=1e-9, atol=1e-7) and np.allclose(near.rhs, far.rhs, rtol=1e-9, atol=1e-7)
        assert near.zz == pytest.approx(far.zz)
        # The terms above share straight lines, whose determinant is rounding alone: scores are compared without those.
        near, far = (fit_gam(df, "gauss", [Cubic("x", 8), BSpline("z", 6), RandomEffect("g")], weight=weight, opt=Options(discrete=True, local_rows=n)) for n in (10**6, 0))
        assert near.score_value == pytest.approx(far.score_value, rel=1e-9) and near.scale == pytest.approx(far.scale, rel=1e-9) and near.edf_total == pytest.approx(far.edf_total, rel=1e-5)


def test_levels_of_a_random_effect():
    t = RandomEffect("g", levels=["a", "b", "c"])
    assert t.basis(np.array(["c", None, "z", "a"], dtype=object)).tolist() == [[0, 0, 1], [0, 0, 0], [0, 0, 0], [1, 0, 0]]
    assert RandomEffect("g", levels=[1.0, 2.0]).basis(np.array([2, 1, 3])).tolist() == [[0, 1], [1, 0], [0, 0]]
    assert RandomEffect("g", levels=[]).basis(np.array([1.0, np.nan])).shape == (2, 0)


def test_a_fit_leaves_nothing_cached(data, spark):
    df, _ = data
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for discrete in (False, True):
        fit_gam(df.union(df), "gauss", [Cubic("x", 7)], opt=Options(discrete=discrete, local_rows=0))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


FAMILIES = [("gaussian", "gauss", None), ("binomial", "binom", None), ("quasibinomial", "binom", None), ("poisson", "pois", None), ("quasipoisson", "pois", None), ("gamma", "gam", "log"), ("gamma", "gam", "inverse"),
            ("inverse.gaussian", "ig", None), ("nb", "nb", None), ("tweedie", "tw", None), ("scat", "t", None), ("ocat(4)", "cat", None)]


@pytest.fixture(scope="module")
def coarse(data):
    """Many rows to each tuple of covariates, with weights, a random effect and a linear column."""
    df, _ = data
    df = df.withColumns({"x": F.round(F.col("x") * 12) / 12, "z": F.round(F.col("z") * 7) / 7})
    return df.unionByName(df).unionByName(df).cache()


@pytest.mark.parametrize("name,target,link", FAMILIES)
def test_rows_summed_by_tuple_give_the_same_fit(coarse, monkeypatch, name, target, link):
    """Fixed smoothing parameters, weights: sums by tuple, on the driver and over Spark rows, against row by row."""
    terms = lambda: [Cubic("x", 8), BSpline("z", 6)]
    opt = lambda **kw: Options(lam=[3.0, 5.0], **kw)
    summed = [fit_gam(coarse, target, terms(), family(name, link), weight="w", opt=opt(local_rows=n)) for n in (10**6, 0)]
    monkeypatch.setattr(fitting, "WORTH", 10**9)
    plain = fit_gam(coarse, target, terms(), family(name, link), weight="w", opt=opt())
    slow = 200 if name in ("inverse.gaussian", "tweedie") else 1  # expected curvature is far from the observed there: the last steps are short
    for m in summed:
        assert np.allclose(m.beta, plain.beta, atol=2e-8 * slow) and np.allclose(m.edf, plain.edf, atol=1e-6 * slow)
        assert m.deviance == pytest.approx(plain.deviance, rel=1e-9) and m.scale == pytest.approx(plain.scale, rel=1e-8 * slow)
        assert m.score_value == pytest.approx(plain.score_value, rel=1e-8) and m.zz == pytest.approx(plain.zz, rel=1e-7 * slow)


@pytest.mark.parametrize("name,target,link", [f for f in FAMILIES if f[0] in ("binomial", "poisson", "gamma", "tweedie", "nb")])
def test_cells_equal_rounded_rows(data, name, target, link):
    """discrete=True: fits from cells over Spark rows equal fits on the rounded rows themselves, also with a random effect and where
    tuples hardly repeat."""
    df, _ = data
    narrow = df.unionByName(df).withColumn("z", F.round("z", 1))
    narrow = narrow.unionByName(narrow).unionByName(narrow)
    for rows, terms in ((df.unionByName(df.withColumn("x", F.col("x") * 0.9 + 0.01)), lambda: [Cubic("x", 8), BSpline("z", 6)]), (narrow, lambda: [BSpline("x", 9), Cubic("z", 4), RandomEffect("g")])):
        lam = [2.0, 3.0, 1.0][: len(terms())]
        near, far = (fit_gam(rows, target, terms(), family(name, link), opt=Options(lam=lam, discrete=True, local_rows=n)) for n in (10**6, 0))
        assert np.allclose(near.beta, far.beta, atol=1e-8) and near.deviance == pytest.approx(far.deviance, rel=1e-9)
        chosen = [fit_gam(rows, target, terms(), family(name, link), opt=Options(method="fREML", discrete=True, local_rows=n)) for n in (10**6, 0)]
        assert chosen[0].edf_total == pytest.approx(chosen[1].edf_total, abs=2e-3)


def _held(data, target, fam):
    df, _ = data
    pdf = df.toPandas()
    m = fit_gam(df, target, smooths(), fam, opt=Options(lam=[4.0, 9.0]))
    rows = LocalRows({TARGET: pdf[target].to_numpy(), WEIGHT: np.ones(len(pdf)), "x": pdf["x"].to_numpy(), "z": pdf["z"].to_numpy()})
    return m, Statistics(rows, Design(m.terms), m.fam)


@pytest.mark.parametrize("name,target,link", [f for f in FAMILIES if f[0] not in ("gaussian", "scat")])
def test_exact_slope_equals_differences(data, name, target, link):
    """The implicit slope of the Laplace score against differences over whole iterations, at log lambdas away from the best."""
    m, stats = _held(data, target, family(name, link))
    sums, pen = stats.likelihood(m.fam), stats.design.penalties
    at = lambda: ExactScore(stats, m.fam, pen, sums, Options(), m.beta)
    for rho in (np.log([4.0, 9.0]), np.log([300.0, 0.5])):
        got, e = at().slope(rho), 1e-3
        want = [(at().score(rho + e * d) - at().score(rho - e * d)) / (2 * e) for d in np.eye(2)]
        # Steps by expected curvature end a little off the optimum where the observed one is another, and differences tell.
        assert np.allclose(got, want, atol=(1e-4 if name == "inverse.gaussian" else 2e-5) * (1 + np.abs(want).max()))


def test_joint_derivatives_equal_differences(data):
    m, stats = _held(data, "gauss", family("gaussian"))
    w, pen, x, e = select.Working(m.gram, m.rhs, m.zz, m.rows), stats.design.penalties, np.array([1.0, 2.5, -1.5]), 1e-4
    f, g, h = w.joint(pen, x[:2], x[2])
    at = lambda v: w.joint(pen, v[:2], v[2])
    assert np.allclose(g, [(at(x + e * d)[0] - at(x - e * d)[0]) / (2 * e) for d in np.eye(3)], rtol=1e-6, atol=1e-6)
    assert np.allclose(h, [(at(x + e * d)[1] - at(x - e * d)[1]) / (2 * e) for d in np.eye(3)], rtol=1e-5, atol=1e-5)
    assert f == pytest.approx(w.reml(pen, x[:2], math.exp(x[2])))
    # The joint steps end where the search over log lambda alone does.
    for target, fam in (("gauss", "gaussian"), ("pois", "poisson"), ("gam", "gamma")):
        one, two = (fit_gam(data[0], target, smooths(), family(fam, "log" if fam == "gamma" else None), opt=o) for o in (Options(method="fREML"), Options(exact=False)))
        assert np.allclose(one.edf, two.edf, atol=2e-3)


def test_published_fit_by_joint_steps(spark):
    with open(os.path.join(os.path.dirname(__file__), "golden_cubic.json")) as f:
        d = json.load(f)
    m = fit_gam(spark.createDataFrame(list(zip(d["x"], d["y"])), "x double, y double"), "y", [Cubic("x", 10)], opt=Options(method="fREML"))
    assert m.lam[0] == pytest.approx(d["lambda"][0], rel=1e-5) and m.score_value == pytest.approx(d["score"], abs=1e-8)


def test_one_job_an_outer_step(data, monkeypatch):
    """Each outer step of fREML reads the rows once; a step that is shortened reads them twice, however far."""
    df, _ = data
    jobs, steps = [], []
    reduce, step = LocalRows.reduce, select.Working.freml_step
    monkeypatch.setattr(LocalRows, "reduce", lambda self, kernel: jobs.append(1) or reduce(self, kernel))
    monkeypatch.setattr(select.Working, "freml_step", lambda self, *a: steps.append(1) or step(self, *a))
    fit_gam(df, "pois", smooths(), "poisson", opt=Options(method="fREML"))
    assert 3 <= len(steps) and len(jobs) <= len(steps) + 4  # and the constraints, the likelihood, the start and the final scale
    x = np.linspace(-3, 3, 400)
    rows = LocalRows({TARGET: (x > 0).astype(float), WEIGHT: np.ones(400), "x": x})
    t = Linear("x")
    t.prepare(np.zeros(0), 400, 1.0)
    stats = Statistics(rows, Design([t]), family("binomial"))
    jobs.clear()
    beta, s, it = pirls(stats, stats.fam, np.zeros(0), np.array([40.0, -30.0]), Options(most_iterations=20))
    assert len(jobs) <= 2 * it + 1 and s["dev"] < 1e-3


def test_tuples_are_summed_before_rows_move(coarse):
    rows = fitting.prepared(coarse, "pois", smooths(), "w", "fail")
    few = fitting.summed(rows, ["x", "z"], family("poisson"), "moments", 2.0)
    plan = few._jdf.queryExecution().explainString(coarse.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "partial_sum" in plan and plan.count("Exchange") == 1
    got, n = few.agg(F.sum("__n"), F.sum("__w"), F.sum(F.col("__w") * F.col("__y"))).first(), rows.agg(F.count("*"), F.sum("__w"), F.sum(F.col("__w") * F.col("__y"))).first()
    assert np.allclose(list(got), list(n))
    assert isinstance(SparkRows(few, few.columns).reduce(lambda c: (np.array([len(c["__y"])]), np.zeros(1)))[0][0].item(), (int, float))
