"""Frames in: Spark DataFrames, pandas frames, arrays or files become DataFrames of named columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "csv", "json", "orc")


def ingest(spark: SparkSession, x, expected: list[str] | None = None) -> DataFrame:
    """A DataFrame of x: as it is, from pandas (or anything with to_pandas), or from an array, whose columns become x0, x1, ...
    With expected, those columns in that order; missing ones are named."""
    if isinstance(x, DataFrame):
        df = x
    elif isinstance(x, pd.DataFrame) or hasattr(x, "to_pandas"):
        df = spark.createDataFrame(x if isinstance(x, pd.DataFrame) else x.to_pandas())
    else:
        a = np.asarray(x, np.float64)
        a = a[:, None] if a.ndim == 1 else a
        if a.ndim != 2:
            raise ValueError(f"expected one or two dimensions, got {a.ndim}")
        df = spark.createDataFrame(pd.DataFrame(a, columns=[f"x{i}" for i in range(a.shape[1])]))
    if expected is not None:
        missing = [c for c in expected if c not in df.columns]
        if missing:
            raise ValueError(f"columns not found: {', '.join(missing)}")
        df = df.select(*expected)
    return df


def with_response(spark: SparkSession, x, y, name: str = "y", weight=None) -> DataFrame:
    """x as a frame with the response and, if given, weights: column names of x, or one-dimensional data in the order of rows."""
    if isinstance(x, DataFrame):
        if not isinstance(y, str):
            raise ValueError("for a DataFrame, name the response column")
        return x
    pdf = x if isinstance(x, pd.DataFrame) else x.to_pandas() if hasattr(x, "to_pandas") else None
    if pdf is None:
        a = np.asarray(x, np.float64)
        a = a[:, None] if a.ndim == 1 else a
        pdf = pd.DataFrame(a, columns=[f"x{i}" for i in range(a.shape[1])])
    pdf = pdf.copy()
    for n, v in ((name, y), ("weight", weight)):
        if v is not None and not isinstance(v, str):
            v = np.asarray(v, np.float64)
            v = v[:, 0] if v.ndim == 2 and v.shape[1] == 1 else v
            if v.ndim != 1 or len(v) != len(pdf):
                raise ValueError(f"{n} needs {len(pdf)} values in one dimension")
            pdf[n] = v
    return spark.createDataFrame(pdf)


def read(spark: SparkSession, path: str, kind: str = "parquet", columns: list[str] | None = None) -> DataFrame:
    """Rows of a file in any of FORMATS; only the columns named are read."""
    if kind not in FORMATS:
        raise ValueError(f"formats are {', '.join(FORMATS)}")
    reader = spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read
    df = reader.format(kind).load(path)
    return df.select(*columns) if columns else df


def ranges(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Least and greatest value of each column, NaN and nulls left out; one aggregation."""
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    r = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(clean.values()) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (r[f"lo{i}"], r[f"hi{i}"]) for i, c in enumerate(columns)}
