import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.api import Gam, Predictor
from ridgeline.operators.fit import fit_gam
from ridgeline.operators.terms import Cubic, Linear


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(400).select("id", (F.col("id") / 400).alias("x"), (F.col("id") % 7).cast("double").alias("z"), F.lit("s").alias("text")).withColumn("y", F.sin(6 * F.col("x")) + 0.1 * F.col("z") + 0.01 * (F.col("id") % 5)).cache()


@pytest.fixture(scope="module")
def model(df):
    return fit_gam(df, "y", [Cubic("x", 8), Linear("z")])


def test_a_frozen_predictor(df, model):
    p = Predictor(model)
    assert p.columns == ["x", "z"] and "identity" in repr(p) and p.edf_total == model.edf_total and p["x"].columns == ["x"]
    with pytest.raises(AttributeError):
        p.model = None
    with pytest.raises(AttributeError):
        p.fit
    shuffled = df.select("text", "z", "id", "x")  # columns go by name
    a, b = (d.orderBy("id").toPandas()["prediction"] for d in (p.transform(shuffled), model.transform(df)))
    assert np.array_equal(a, b)
    with pytest.raises(ValueError, match="not found: z"):
        p.transform(df.drop("z"))
    with pytest.raises(ValueError, match="numbers: x"):
        p.transform(df.withColumn("x", F.col("text")))
    with pytest.raises(TypeError):
        Predictor(Gam())


def test_checked_against_another_model(df, model):
    p = Predictor(json.loads(json.dumps(model.to_json())))
    p.check_against(model, df)
    with pytest.raises(AssertionError, match="400 predictions differ"):
        p.check_against(fit_gam(df.withColumn("y", F.col("y") + 1), "y", [Cubic("x", 8), Linear("z")]), df)
    p.check_against(model, df.limit(0))


def test_changes(df, model):
    later = df.withColumn("x", F.col("x") + 0.1)
    at = lambda d: d.orderBy("id").toPandas()
    eta = lambda d: at(model.transform(d))["prediction"].to_numpy()
    assert at(model.change(df, later, on="id"))["diff"].to_numpy() == pytest.approx(eta(later) - eta(df))
    one = df.where("id = 7")
    for level in (None, 0.9):
        up = at(model.change(one, df, broadcast="from", level=level))
        down = at(model.change(df, one, broadcast="to", level=level))
        assert up["diff"].to_numpy() == pytest.approx(eta(df) - eta(one)[0]) and down["diff"].to_numpy() == pytest.approx(-up["diff"].to_numpy())
    assert down["lower"].to_numpy() == pytest.approx(-up["upper"].to_numpy())
    # The shared part of the coefficients' error drops out: narrower than the difference of two intervals.
    wide = at(model.transform_ci(df, level=0.9))
    own = at(model.transform_ci(one, level=0.9)).iloc[0]
    assert ((up["upper"] - up["lower"]) <= (wide["upper"] - wide["lower"]) + own["upper"] - own["lower"]).all() and (up["lower"] <= up["diff"]).all()
    assert up["upper"][7] - up["lower"][7] == pytest.approx(0, abs=1e-9)


def test_changes_refused(df, model):
    with pytest.raises(ValueError, match="once"):
        model.change(df, df.where("id > 0"), on="id")
    with pytest.raises(ValueError, match="once"):
        model.change(df.union(df), df, on="id")
    with pytest.raises(ValueError, match="one row"):
        model.change(df, df, broadcast="from")
    with pytest.raises(ValueError, match="none, from or to"):
        model.change(df, df, broadcast="both")
    with pytest.raises(ValueError, match="paired"):
        model.change(df, df)
    with pytest.raises(NotImplementedError):
        fit_gam(df.withColumn("y", F.col("z")), "y", [Linear("x")], "poisson").change(df, df, on="id")
