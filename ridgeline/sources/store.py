"""Models out and in: one JSON row in a Parquet folder, so that any file system that Spark reaches will do."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.model import GamModel


def save(model: GamModel, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
    spark.createDataFrame([(model.to_json(),)], "model string").coalesce(1).write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> GamModel:
    return GamModel.from_json(spark.read.parquet(path).first()["model"])


def artefact_frame(model: GamModel, spark: SparkSession, n_points: int = 100, range_multiplier: float = 1.0) -> DataFrame:
    """The scoring artefact as rows: point, the predictors' values and the prediction matrix row."""
    a = model.artefact(n_points, range_multiplier)
    rows = [(i, [str(v) for v in vals[1:]], [float(v) for v in lp]) for i, (vals, lp) in enumerate(zip(a["lp_feature_values"], np.asarray(a["lp_matrix"], float)))]
    return spark.createDataFrame(rows, "point int, features array<string>, lp array<double>")
