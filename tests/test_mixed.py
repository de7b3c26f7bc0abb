import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import mixed
from ridgeline.operators.fit import MOST_LEVELS, Options, fit_gam
from ridgeline.operators.mixed import fit_mixed
from ridgeline.operators.terms import Cubic, Linear, RandomEffect


@pytest.fixture(scope="module")
def grouped(spark):
    rng = np.random.default_rng(8)
    n = 3000
    g, x, z = rng.integers(0, 40, n), rng.random(n), rng.random(n)
    y = np.sin(6 * x) + 0.5 * z + 0.4 * rng.normal(size=40)[g] + rng.normal(0, 0.3, n)
    return spark.createDataFrame(pd.DataFrame({"g": [f"g{i:02d}" for i in g], "x": x, "z": z, "y": y, "w": rng.integers(1, 4, n).astype(float)})).repartition(5).cache()


@pytest.mark.parametrize("weight", [None, "w"])
def test_fixed_parameters_equal_the_dense_fit(grouped, weight):
    terms = lambda: [Cubic("x", 8), Linear("z")]
    dense = fit_gam(grouped, "y", [*terms(), RandomEffect("g")], weight=weight, opt=Options(lam=[2.0, 5.0]))
    m = fit_mixed(grouped, "y", "g", terms(), weight=weight, opt=Options(lam=[2.0, 5.0]))
    p = len(m.fixed.beta)
    assert np.allclose(m.fixed.beta, dense.beta[:p], atol=1e-9)
    found = m.effects.orderBy("level").toPandas()
    assert np.allclose(found["effect"], dense.coef["g"], atol=1e-9) and list(found["level"]) == dense.terms[-1].levels
    assert m.fixed.score_value == pytest.approx(dense.score_value, rel=1e-10)
    assert m.edf_levels == pytest.approx(dense.edf_by_term["g"], rel=1e-8) and np.allclose(m.fixed.edf, dense.edf[:p], atol=1e-9)
    both = m.transform(grouped).join(dense.transform(grouped, column="other"), ["g", "x", "z"])
    assert both.agg(F.max(F.abs(F.col("prediction") - F.col("other")))).first()[0] < 1e-9
    m.release()


def test_chosen_parameters_equal_the_dense_fit(grouped):
    dense = fit_gam(grouped, "y", [Cubic("x", 8), RandomEffect("g")])
    m = fit_mixed(grouped, "y", "g", [Cubic("x", 8)])
    assert m.fixed.score_value == pytest.approx(dense.score_value, abs=1e-4)
    assert m.lam == pytest.approx(dense.lam[1], rel=2e-2) and np.allclose(m.fixed.beta, dense.beta[: len(m.fixed.beta)], atol=2e-3)
    m.release()


def test_a_hundred_thousand_levels(spark):
    """Each with two rows or three, one with a third of all, and rows of no level; nothing dense, and nothing of theirs on the driver."""
    n, k = 300_000, 100_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 1000 == 1, None).otherwise(F.col("id") % k).alias("g"), F.rand(3).alias("x"), F.randn(4).alias("e"))
    df = df.withColumn("y", F.coalesce(F.sin(F.col("g").cast("double") * 12.9898), F.lit(0.0)) + 2 * F.col("x") + 0.5 * F.col("e")).persist()
    assert df.count() == n
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    m = fit_mixed(df, "y", "g", [Linear("x")])
    assert m.levels > 60_000 and m.fixed.beta[1] == pytest.approx(2.0, abs=0.02)
    assert 0.3 < m.lam < 0.8  # noise of 0.25 over a variance of 0.5
    r = m.transform(df).agg(F.corr("prediction", "y").alias("r"), F.count("prediction").alias("n")).first()
    assert r["r"] > 0.8 and r["n"] == n
    m.release()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    with pytest.raises(ValueError, match="levels"):
        fit_gam(df.where("g IS NOT NULL"), "y", [RandomEffect("g")], opt=Options(local_rows=0))
    df.unpersist()


def test_edges(grouped):
    assert MOST_LEVELS >= 1000 and mixed.ROUNDS > 1
    only = fit_mixed(grouped, "y", "g", opt=Options(lam=[3.0]))
    assert len(only.fixed.beta) == 1
    unseen = only.transform(grouped.limit(3).withColumn("g", F.lit("never"))).toPandas()["prediction"]
    assert np.allclose(unseen, only.fixed.beta[0])
    only.release()
    with pytest.raises(ValueError):
        fit_mixed(grouped, "y", "g", opt=Options(method="GCV"))
    with pytest.raises(ValueError):
        fit_mixed(grouped.where("y > 1e9"), "y", "g")
