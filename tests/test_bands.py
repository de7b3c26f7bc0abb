import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import bands, diagnostics
from ridgeline.operators.fit import Options, Statistics
from ridgeline.operators.quantile import Tuner, fit_quantile
from ridgeline.operators.rows import SparkRows
from ridgeline.operators.terms import Cubic


@pytest.fixture(scope="module")
def many(spark):
    x = (F.col("id") % 6).cast("double")
    return spark.range(40_000, numPartitions=3).select(x.alias("x"), (F.sin(x) + 10 + F.randn(3) * (1 + x / 6)).alias("y"), (1 + F.col("id") % 3).cast("double").alias("w")).localCheckpoint()


def tuners(df, weight=None):
    a, b = (Tuner(df, "y", [Cubic("x", 4)], 0.9, weight, Options(local_rows=10)) for _ in range(2))
    assert a.nodes is not None
    b.nodes = None  # over the rows themselves
    return a, b


@pytest.mark.parametrize("weight", [None, "w"])
def test_bands_stand_for_their_rows(many, weight):
    a, b = tuners(many, weight)
    fam, beta = a.family(a.auto()), a.begin + 0.3
    got, want = (Statistics(r, a.design, fam).at(beta, old=a.begin) for r in (a.nodes, a.rows))
    for k in ("g", "r", "dev", "n", "line"):
        assert np.allclose(got[k], want[k], rtol=1e-10, atol=1e-9 * want["n"]), k
    (x, _), (y, _) = a.fit(a.auto()), b.fit(b.auto())
    assert np.allclose(x, y, rtol=1e-7) and np.allclose(a.lam, b.lam, rtol=1e-5)


def test_tuning_by_bands_is_that_over_rows(many):
    a, b = tuners(many)
    assert a.cv_losses([0.1, 0.6], 3) == pytest.approx(b.cv_losses([0.1, 0.6], 3), rel=1e-9)
    assert a.kl(0.2, replicates=4) == pytest.approx(b.kl(0.2, replicates=4), rel=1e-6)
    assert a.by_replicate is not None and not hasattr(b, "by_replicate")


def test_iterations_of_a_quantile_dont_read_the_rows(many, monkeypatch):
    """However many steps a fit takes, the rows are read once after they are summed: for the final statistics."""
    read, own = [], SparkRows.reduce
    monkeypatch.setattr(SparkRows, "reduce", lambda self, *more: read.append(self) or own(self, *more))
    fit_quantile(many, "y", [Cubic("x", 4)], 0.9, opt=Options(local_rows=10_000, lam=None), calibrate=False)
    assert len(read) == 1


def test_tasks_hand_on_sums_in_time(many, monkeypatch):
    a, _ = tuners(many)
    beta, fam = a.begin, a.family(0.3)
    want = Statistics(a.nodes, a.design, fam).at(beta)["g"]
    monkeypatch.setattr(bands, "HELD", 3)
    assert np.allclose(Statistics(a.noded(a.rows.df), a.design, fam).at(beta)["g"], want, rtol=1e-9)


def test_order_statistics_by_smaller_and_smaller_cells(spark, monkeypatch):
    monkeypatch.setattr(diagnostics, "FEW", 5)
    monkeypatch.setattr(diagnostics, "CELLS", 4)
    v = [float(i * i) for i in range(300)] + [7.0] * 50 + [1e300, -1e300, 1.7e308, -1.7e308] + [1e-300 * i for i in range(20)]
    df = spark.createDataFrame([(x,) for x in v], "v double").repartition(3)
    ranks = [0, 1, 2, 30, 60, 200, len(v) - 2, len(v) - 1]
    assert diagnostics.order_statistics(df, F.col("v"), lambda n: ranks) == [sorted(v)[k] for k in ranks]
