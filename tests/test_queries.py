"""Every query with SQL against it, and every other one's rows, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ridgeline.operators import model
from ridgeline.operators.model import DRAWS, GamModel
from ridgeline.plans import catalog
from ridgeline.plans.scoring import given_model

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    keys = [c for c in cols if got[c].dtype.kind != "f"] + [c for c in cols if got[c].dtype.kind == "f"]
    a, b = got.sort_values(keys).reset_index(drop=True), want.sort_values(keys).reset_index(drop=True)
    for c in cols:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=0, atol=1e-9, equal_nan=True), c
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_posterior_has_the_default_number_of_draws(spark):
    got = catalog.QUERIES["posterior_samples"](spark, SF)
    assert got.selectExpr("min(size(samples)) AS a", "max(size(samples)) AS b").first() == (DRAWS, DRAWS)


def test_posterior_rows_of_equal_covariates_follow_each_other(spark):
    """Equal rows' draws lie side by side in files; every line keeps its own."""
    got = catalog.QUERIES["posterior_samples"](spark, SF).select("l_orderkey", "l_linenumber", F.hash("samples").alias("h")).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    parts = max(1, spark.read.parquet(f"{SF}/lineitem.parquet").rdd.getNumPartitions())
    assert (got["h"] != got["h"].shift()).sum() <= parts * got["h"].nunique()


def test_posterior_draws_are_computed_once_a_tuple(spark, monkeypatch):
    """Few tuples of covariates, null and NaN among them, are joined to their rows; else each row's draws are computed, to the same end."""
    rows = [(i, float(i % 3) if i % 5 else None, float("nan") if i % 7 == 0 else 0.1, "AN"[i % 2] if i % 4 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, l_quantity double, l_discount double, l_returnflag string").repartition(3)
    seen, arrow = [], GamModel._arrow
    monkeypatch.setattr(GamModel, "_arrow", lambda self, df, f, added: seen.append(df.count()) or arrow(self, df, f, added))

    def draws():
        got = {r["id"]: r["samples"] for r in given_model().posterior(df, n=50).collect()}
        return np.array([got[i] for i in range(200)], np.float64)

    few = draws()
    monkeypatch.setattr(model, "SHIPPED", 0)
    assert np.allclose(few, draws(), rtol=0, atol=1e-12, equal_nan=True) and np.isfinite(few).any()
    assert seen == [df.select("l_quantity", "l_discount", "l_returnflag").distinct().count(), 200] and seen[0] < 100
