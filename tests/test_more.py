import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import binning, linalg
from ridgeline.operators.diagnostics import coverage_shift, k_index, kl_loss, order_statistic
from ridgeline.operators.fit import Options, fit_gam
from ridgeline.operators.quantile import Tuner, calibration_loss, fit_location_scale, fit_quantile, fold_counts, folds, pinball_loss, poisson_times, predictive_sd, shash_cdf, shash_fit, shash_quantile
from ridgeline.operators.rows import LocalRows
from ridgeline.operators.terms import Cubic
from ridgeline.streaming.incremental import RunningFit


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(2)
    x = rng.random(1200)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(1200), "x": x, "y": np.sin(6 * x) + rng.normal(0, 0.2 + 0.3 * x, 1200)})).cache()


@pytest.mark.parametrize("tau", [0.1, 0.9])
def test_quantile_covers(noisy, tau):
    q = fit_quantile(noisy, "y", [Cubic("x", 8)], tau)
    p = q.transform(noisy).toPandas()
    assert (p["y"] <= p["prediction"]).mean() == pytest.approx(tau, abs=0.01)
    flat = np.quantile(p["y"], tau)
    assert pinball_loss(p["y"].to_numpy(), p["prediction"].to_numpy(), tau) < pinball_loss(p["y"].to_numpy(), np.full(len(p), flat), tau)


def test_tuned_quantile(noisy):
    q = fit_quantile(noisy, "y", [Cubic("x", 6)], 0.8, preset="quality_oos")
    assert 1e-3 < q.sigma < 5 and q.trace
    with pytest.raises(ValueError):
        fit_quantile(noisy, "y", [Cubic("x", 6)], 0.8, preset="no")


def _elf(beta, x, y, sigma, tau, s):
    """Half the penalised deviance of the smoothed check loss with a scale for each row, and its slope."""
    r = (y - x @ beta) / sigma
    return (np.logaddexp(0, r) - (1 - tau) * r).sum() + 0.5 * beta @ s @ beta, x.T @ (((1 - tau) - 1 / (1 + np.exp(-r))) / sigma) + s @ beta


@pytest.mark.parametrize("local_rows", [200_000, 10])
def test_location_scale_solves_its_own_equations(noisy, local_rows):
    """Kept smoothing parameters: the slope of the loss, written out with a scale for each row, vanishes; in memory and in Spark."""
    opt = Options(local_rows=local_rows)
    q = fit_location_scale(noisy, "y", [Cubic("x", 6)], 0.9, opt=opt, retune=False)
    p = q.transform(noisy, scale="s").toPandas()
    mean = fit_gam(noisy, "y", [Cubic("x", 6)], opt=opt)
    assert q.model.lam == pytest.approx(mean.lam)
    assert q.mean_scale == pytest.approx(p["s"].mean())
    sigma = q.sigma * p["s"].to_numpy() / p["s"].mean()
    x, s = q.model.design({"x": p["x"].to_numpy()}), np.zeros((6, 6))
    s[1:, 1:] = q.model.lam[0] * q.model.terms[0].s
    f, slope = _elf(q.model.beta, x, p["y"].to_numpy(), sigma, 0.9, s)
    assert np.abs(slope).max() < 1e-3 * abs(f) and all(_elf(q.model.beta + d, x, p["y"].to_numpy(), sigma, 0.9, s)[0] >= f - 1e-6 for d in 1e-2 * np.eye(6))
    assert p["prediction"].to_numpy() == pytest.approx(x @ q.model.beta)


@pytest.fixture(scope="module")
def uneven(spark):
    """A scale of 0.1 + 0.4 |a| around sin 2a + b / 2."""
    rng = np.random.default_rng(7)
    a, b = rng.uniform(-1, 1, (2, 800))
    s = 0.1 + 0.4 * np.abs(a)
    return spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "s_true": s, "y": np.sin(2 * a) + b / 2 + s * rng.standard_normal(800)})).cache()


@pytest.mark.parametrize("tau", [0.1, 0.5, 0.9])
def test_location_scale_covers_and_finds_the_scale(uneven, tau):
    q = fit_location_scale(uneven, "y", [Cubic("a", 10), Cubic("b", 10)], tau, scale_terms=[Cubic("a", 5), Cubic("b", 5)])
    p = q.transform(uneven, scale="s").toPandas()
    assert (p["y"] < p["prediction"]).mean() == pytest.approx(tau, abs=0.05)
    assert (p["s"] - p["s_true"]).abs().mean() / p["s_true"].mean() < 0.3 and p["s"].corr(p["s_true"]) > 0.85
    one = q.sigma
    assert fit_location_scale(uneven, "y", [Cubic("a", 10), Cubic("b", 10)], tau, sigma=2 * one).sigma == 2 * one


def test_an_even_scale_is_found_even(spark):
    rng = np.random.default_rng(11)
    a, b = rng.uniform(-1, 1, (2, 800))
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "y": np.sin(2 * a) + b / 2 + 0.3 * rng.standard_normal(800)}))
    s = fit_location_scale(df, "y", [Cubic("a", 10), Cubic("b", 10)], 0.5).transform(df, scale="s").toPandas()["s"]
    assert (s.max() - s.min()) / s.mean() < 0.4


@pytest.mark.parametrize("preset,local_rows", [("quality_oos", 200_000), ("quality_oos", 10), ("kl", 200_000)])
def test_location_scale_is_tuned(uneven, preset, local_rows):
    q = fit_location_scale(uneven, "y", [Cubic("a", 8), Cubic("b", 8)], 0.5, preset=preset, opt=Options(local_rows=local_rows), multifidelity=True)
    p = q.transform(uneven).toPandas()
    assert (p["y"] < p["prediction"]).mean() == pytest.approx(0.5, abs=0.05)
    # The search's last three losses are the full model's, and the least of them decides.
    tried = q.quantile.trace[-3:]
    assert q.sigma == min(tried, key=lambda x: x[1])[0] and np.diff(np.log([x[0] for x in tried])) == pytest.approx(0.3)
    with pytest.raises(ValueError, match="unknown preset"):
        fit_location_scale(uneven, "y", [Cubic("a", 8)], 0.5, preset="unknown")


def test_candidates_side_by_side_are_those_one_by_one(noisy):
    for local_rows in (10, 200_000):
        t = Tuner(noisy, "y", [Cubic("x", 5)], 0.8, opt=Options(local_rows=local_rows))
        t.fit(0.2)
        each = [t.cv_loss(v) for v in (0.1, 0.2, 0.4)]
        assert t.cv_losses([0.1, 0.2, 0.4]) == pytest.approx(each, rel=1e-9)
        t.release()


def test_quantile_fits_give_back_their_caches(noisy, spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for fit in (fit_quantile, fit_location_scale):
        fit(noisy, "y", [Cubic("x", 4)], 0.8, opt=Options(local_rows=10))
    t = Tuner(noisy, "y", [Cubic("x", 4)], 0.8, opt=Options(local_rows=10))
    t.cv_losses([0.3])
    t.release()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_sinh_arcsinh(noisy):
    p = shash_fit(noisy, "y")
    y = noisy.toPandas()["y"]
    assert shash_cdf(np.median(y), p) == pytest.approx(0.5, abs=0.05)
    assert float(shash_cdf(shash_quantile(0.3, p), p)) == pytest.approx(0.3, abs=1e-6)


def test_losses_and_folds(spark, noisy):
    z = np.random.default_rng(0).normal(size=(30, 50))
    long = spark.createDataFrame([(j, float(z[i, j])) for i in range(30) for j in range(50)], "row int, z double")
    assert kl_loss(long, "row", "z") == pytest.approx(calibration_loss(z), rel=1e-9)
    a, b = (dict(folds(noisy.repartition(n), "id", 4).select("id", "fold").collect()) for n in (2, 9))
    assert a == b and set(a.values()) == {0, 1, 2, 3}


def test_order_statistics(spark):
    df = spark.createDataFrame([(float(v),) for v in (5, 1, 3, 2, 4)] + [(float("nan"),), (None,)], "v double")
    assert order_statistic(df, F.col("v"), 0.5) == 3 and order_statistic(df, F.col("v"), 0.9) == 4
    two = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0), (3.0, 0.0)], "y double, q double")
    assert coverage_shift(two, "y", "q", 0.5) == 2


def test_order_statistics_leave_no_task_all_values(spark, monkeypatch):
    """Exact ranks by brackets, several in the same jobs, with outliers and heavy ties; no aggregate holds every distinct value."""
    from ridgeline.operators import diagnostics

    monkeypatch.setattr(diagnostics.F, "percentile", None)
    monkeypatch.setattr(diagnostics, "ACCURACY", 50, raising=False)
    v = np.random.default_rng(4).standard_cauchy(20_000)
    v[::3], v[:2] = 0.25, (-1e300, 1e300)
    df, taus = spark.createDataFrame([(float(x), 0.0) for x in v], "y double, q double").repartition(7), (0.0, 0.1, 0.5, 0.6, 0.95, 1.0)
    want = np.sort(v)[[int((len(v) - 1) * t) for t in taus]].tolist()
    assert [coverage_shift(df, "y", "q", t) for t in taus] == want
    assert diagnostics.coverage_shifts(df, "y", "q", taus) == want


def test_k_index_over_ranges(noisy, monkeypatch):
    from ridgeline.operators import diagnostics

    pdf = noisy.toPandas().sort_values(["x", "id"])
    r = pdf["y"].to_numpy()
    want = (np.diff(r) ** 2).sum() / (2 * r.var() * (len(r) - 1))
    assert k_index(noisy, "x", F.col("y"), "id") == pytest.approx(want)
    monkeypatch.setattr(diagnostics, "CHUNK", 100)
    assert k_index(noisy, "x", F.col("y"), "id") == pytest.approx(want)
    assert k_index(noisy, "x", F.lit(1.0), "id") == 1.0


def test_cells_equal_dense(noisy):
    lo, hi = 0.0, 1.0
    df = noisy.select(binning.bin_index(F.col("x"), lo, hi, 20).alias("a"), (F.col("id") % 7).cast("int").alias("b"), (F.lit(1.0) + F.col("id") % 3).alias("w"), F.col("y").alias("z"))
    ba, bb = np.random.default_rng(0).normal(size=(21, 4)), np.random.default_rng(1).normal(size=(7, 3))
    g, r = binning.gram_from_cells(binning.cell_sums(df, ["a", "b"], "w", "z").toPandas(), ["a", "b"], [ba, bb])
    p = df.toPandas()
    x = np.concatenate([ba[p["a"]], bb[p["b"]]], axis=1)
    assert np.allclose(g, x.T @ (x * p["w"].to_numpy()[:, None])) and np.allclose(r, x.T @ (p["w"] * p["z"]).to_numpy())
    eta = df.select(binning.cell_eta(["a", "b"], [ba[:, 0], bb[:, 0]]).alias("e"), "a", "b").toPandas()
    assert np.allclose(eta["e"], ba[eta["a"], 0] + bb[eta["b"], 0])
    assert binning.collapse(df, ["a", "b"], "z", "w").agg(F.sum("sw")).first()[0] == pytest.approx(p["w"].sum())


def test_running_fit_follows_batches(spark, noisy, tmp_path):
    first, rest = noisy.where("id < 600"), noisy.where("id >= 600")
    run = RunningFit(fit_gam(first, "y", [Cubic("x", 8)]))
    run.add(rest, 1)
    run.add(rest, 1)
    assert run.model.rows == 1200
    whole = fit_gam(noisy, "y", [Cubic("x", 8)])
    x = {"x": np.linspace(0.05, 0.95, 30)}
    assert np.allclose(run.model.design(x) @ run.model.beta, whole.design(x) @ whole.beta, atol=0.05)
    rest.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rest.schema).parquet(f"{tmp_path}/in")
    other = RunningFit(fit_gam(first, "y", [Cubic("x", 8)]))
    other.follow(stream, f"{tmp_path}/ck").awaitTermination()
    assert np.allclose(other.model.beta, run.model.beta, atol=1e-6)


def _rows_of(spark, n=1200):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, n).round(2)
    rows = [(float(a), float(b)) for a, b in zip(x, (np.sin(6 * x) + rng.normal(0, 0.3, n)).round(2))]
    return spark.createDataFrame(rows + [(0.5, 0.25)] * 400, "x double, y double")


@pytest.mark.parametrize("preset", ["quality_oos", "kl"])
def test_quantiles_are_tuned_over_rows_in_spark(spark, preset):
    df = _rows_of(spark)
    q = fit_quantile(df, "y", [Cubic("x", 5)], 0.8, preset=preset, opt=Options(local_rows=10))
    assert len(q.trace) > 3 and min(v for _, v in q.trace) == dict(q.trace)[q.sigma]


def test_losses_in_spark_equal_plain_refits(spark):
    df = _rows_of(spark)
    t = Tuner(df, "y", [Cubic("x", 5)], 0.8, opt=Options(local_rows=10))
    cv, kl = t.cv_loss(0.1), t.kl(0.1, replicates=6)
    assert Tuner(df.repartition(7), "y", [Cubic("x", 5)], 0.8, opt=Options(local_rows=10)).kl(0.1, replicates=6) == pytest.approx(kl, rel=1e-5)
    pdf = t.counted(5).df.toPandas()
    cols = {c: pdf[c].to_numpy() for c in pdf.columns}
    x, copies = t.design.matrix(cols), cols["__copies"]
    assert copies.sum() == 1600 and copies.max() >= 400
    t2, want = Tuner(df, "y", [Cubic("x", 5)], 0.8, opt=Options(local_rows=10)), 0.0
    t2.fit(0.1)
    inside = fold_counts(cols["fold"], copies, 5)
    assert (inside.sum(1) == copies).all() and inside[copies >= 400].min() >= 80
    for i in range(5):
        def taken(m):
            return LocalRows({c: np.repeat(v, m) for c, v in cols.items()})

        b, _ = t2.fit(0.1, taken(copies - inside[:, i]), t2.lam)
        want += pinball_loss(np.repeat(cols["__y"], inside[:, i]), np.repeat(x @ b, inside[:, i]), 0.8) / 5
    assert cv == pytest.approx(want, rel=1e-6)
    b0, s = t2.fit(0.1)
    sd = predictive_sd(x, linalg.inverse(s["g"] + t2.design.penalties.total(t2.lam)))
    times = poisson_times(cols["__hash"], copies, 6, 1)
    z = [(x @ t2.fit(0.1, taken(times[:, r]), t2.lam)[0] - x @ b0) / sd for r in range(6)]
    assert kl == pytest.approx(calibration_loss(np.repeat(np.array(z), copies, axis=1)), rel=1e-4)


def test_bootstrap_weights_are_poisson():
    h = np.random.default_rng(1).integers(-(2**62), 2**62, 4000)
    for copies in (1, 5, 500):
        m = poisson_times(h, np.full(4000, copies), 4, 1)
        assert abs(m.mean() / copies - 1) < 0.05 and abs(m.var() / copies - 1) < 0.1
        assert abs(np.corrcoef(m.T)[0, 1]) < 0.06


def test_diff_refuses_several_rows(spark):
    from ridgeline.plans.scoring import given_model

    left = spark.createDataFrame([(2.0, 0.1, "A"), (3.0, 0.0, "N")], "l_quantity double, l_discount double, l_returnflag string")
    one = given_model().diff(left, left.limit(1)).collect()
    assert len(one) == 2 and one[0]["diff"] == pytest.approx(0.0)
    for right in (left, left.limit(0)):
        with pytest.raises(ValueError, match="one row"):
            given_model().diff(left, right)


def test_a_quantile_begins_at_the_responses_own_over_rows_in_spark(spark):
    """The starting value, between two ranks, is the one that rows in memory give within a step of ranks."""
    from ridgeline.functions.families import Quantile
    from ridgeline.operators import fit as fitting

    y = np.random.default_rng(8).normal(size=501)
    rows = fitting.SparkRows(spark.createDataFrame([(float(v),) for v in y], f"{fitting.TARGET} double"), [fitting.TARGET])
    design = type("D", (), {"p": 2, "penalties": None})()
    start = fitting._first(fitting.Statistics(rows, design, Quantile(tau=0.9)), Quantile(tau=0.9), type("P", (), {"y": {"mean": 0.0}})())
    assert start[0] == np.quantile(y, 0.9)
