"""Basis adequacy, residual order statistics and loss functions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range chunk of the sorted residuals.
CHUNK = 100_000
#: Cells that values are counted by to find an order statistic, and values that are counted each.
CELLS, FEW = 1 << 14, 200_000


def k_index(df: DataFrame, x: str, residual: Column, tie: str) -> float:
    """Mean squared difference of residuals that are next to each other by x, over twice their variance; 1 if they don't vary.

    Ties in x go by `tie`. The order is by ranges of x: rows are sorted within ranges, and a range's first row meets the last of
    the range before it, so that no task sorts all rows."""
    rows = df.select(F.col(x).alias("x"), F.col(tie).alias("t"), residual.cast("double").alias("r"))
    n = rows.count()
    if n < 2:
        return 1.0
    ranged = rows.repartitionByRange(max(1, math.ceil(n / CHUNK)), "x", "t").withColumn("p", F.spark_partition_id())
    inside = Window.partitionBy("p").orderBy("x", "t")
    steps = ranged.withColumn("d", F.col("r") - F.lag("r").over(inside))
    parts = steps.groupBy("p").agg(
        F.sum(F.col("d") ** 2).alias("s"), F.count("*").alias("c"), F.sum("r").alias("r1"), F.sum(F.col("r") ** 2).alias("r2"),
        F.min_by("r", F.struct("x", "t")).alias("first"), F.max_by("r", F.struct("x", "t")).alias("last"), F.min(F.struct("x", "t")).alias("o"),
    ).orderBy("o").collect()
    total = sum(p["s"] or 0.0 for p in parts) + sum((b["first"] - a["last"]) ** 2 for a, b in zip(parts, parts[1:]))
    mean = sum(p["r1"] for p in parts) / n
    var = sum(p["r2"] for p in parts) / n - mean * mean
    return 1.0 if var <= 1e-12 * max(1.0, mean * mean) else total / (2 * var * (n - 1))


def pinball(y: Column, q: Column, tau: float) -> Column:
    """Row loss at the quantile tau; its average is the pinball loss."""
    r = y - q
    return F.greatest(F.lit(tau) * r, F.lit(tau - 1.0) * r)


def order_statistics(df: DataFrame, value: Column, ranks: Callable[[int], list[int]]) -> list[float]:
    """The finite values of the ranks, from 0, that `ranks` gives for their number. Values are counted by cells between the least and the greatest, and
    those in the cells that hold a rank are counted each, or by smaller cells while they are over FEW."""
    # Exploded, so that conditions on the value don't work it out anew, each by itself.
    v = df.select(F.explode(F.array(value.cast("double"))).alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    r = v.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not r["n"]:
        raise ValueError("there are no finite values")
    wanted = ranks(r["n"])
    # The interval that each rank is in: its least and greatest value, their number and that of the values below it.
    inside = [(r["lo"], r["hi"], r["n"], 0)] * len(wanted)
    while any(lo < hi for lo, hi, *_ in inside):
        spans = sorted({x for x in inside if x[0] < x[1]})
        few, cell = sum(x[2] for x in spans) <= FEW, F.lit(None).cast("double")
        for i, (lo, hi, *_) in enumerate(spans):  # halves, so that no difference overflows; the greatest has the last cell alone
            at = F.col("v") if few else F.floor((F.col("v") / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2) * CELLS).cast("double")
            cell = F.when(F.col("v").between(lo, hi), F.struct(F.lit(i).alias("i"), at.alias("at"))) if i == 0 else cell.when(F.col("v").between(lo, hi), F.struct(F.lit(i).alias("i"), at.alias("at")))
        held = v.select("v", cell.alias("c")).where("c is not null").groupBy("c.i", "c.at").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).toPandas().sort_values(["i", "lo"])
        parts = {spans[i]: part for i, part in held.groupby("i")}
        for j, k in enumerate(wanted):
            if inside[j] in parts:
                part, below = parts[inside[j]], inside[j][3]
                upto = below + np.cumsum(part["n"].to_numpy())
                x = part.iloc[int(np.searchsorted(upto, k, "right"))]
                inside[j] = float(x["lo"]), float(x["hi"]), int(x["n"]), int(upto[int(np.searchsorted(upto, k, "right"))] - x["n"])
    return [lo for lo, *_ in inside]


def order_statistic(df: DataFrame, value: Column, tau: float) -> float:
    """The value of rank floor((n - 1) tau), from 0, among the finite ones."""
    return order_statistics(df, value, lambda n: [math.floor((n - 1) * tau)])[0]


def coverage_shifts(df: DataFrame, y: str, fitted: str, taus: Sequence[float]) -> list[float]:
    """coverage_shift at several shares, in the same jobs."""
    return order_statistics(df, F.col(y) - F.col(fitted), lambda n: [math.floor((n - 1) * tau) for tau in taus])


def coverage_shift(df: DataFrame, y: str, fitted: str, tau: float) -> float:
    """What to add to fitted quantiles so that a share tau of the rows lies below."""
    return coverage_shifts(df, y, fitted, [tau])[0]


def kl_loss(replicates: DataFrame, by: str, z: str) -> float:
    """Calibration loss of standardised bootstrap replicates: mean over rows of sqrt(var + mean^2 - log var)."""
    each = replicates.groupBy(by).agg(F.var_samp(z).alias("v"), F.avg(z).alias("m"))
    return float(each.agg(F.avg(F.sqrt(F.greatest(F.lit(0.0), F.col("v") + F.col("m") ** 2 - F.log("v"))))).first()[0])
