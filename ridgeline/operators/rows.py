"""Where the rows of a fit are: in memory, or in a Spark DataFrame. Either answers additive statistics of a numpy kernel."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fits of no more rows than this run on the driver, with the same kernels.
LOCAL_ROWS = 200_000
#: Partial statistics that the driver adds up itself; more are added on the executors first.
DIRECT = 256

Kernel = Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]
Merge = Callable[[np.ndarray, np.ndarray], np.ndarray]


class LocalRows:
    def __init__(self, columns: dict[str, np.ndarray]):
        self.columns = columns

    def reduce(self, kernel: Kernel, merge: Merge = np.add) -> tuple[np.ndarray, np.ndarray]:
        """Sums and maxima that the kernel gives over all rows, taken in slices so that designs stay small. merge: instead of sums."""
        n = len(next(iter(self.columns.values())))
        total = most = None
        for at in range(0, max(n, 1), 50_000):
            s, m = kernel({k: v[at : at + 50_000] for k, v in self.columns.items()})
            total, most = (s, m) if total is None else (merge(total, s), np.maximum(most, m))
        return total, most


class SparkRows:
    def __init__(self, df: DataFrame, columns: list[str], kept: DataFrame | None = None):
        self.df, self.names, self.parts, self.kept = df.select(*columns), columns, None, kept

    def release(self) -> None:
        """Gives back the cache that located() took; the rows can still be read."""
        if self.kept is not None:
            self.kept.unpersist()

    def reduce(self, kernel: Kernel, merge: Merge = np.add) -> tuple[np.ndarray, np.ndarray]:
        """One job: a row of partial statistics for each partition, added up (or merged) in partition order."""
        names = self.names

        def partial(batches):
            from pyspark import TaskContext

            total = most = None
            for b in batches:
                if b.num_rows:
                    s, m = kernel({c: _numpy(b.column(i)) for i, c in enumerate(names)})
                    total, most = (s, m) if total is None else (merge(total, s), np.maximum(most, m))
            if total is not None:
                yield _row(TaskContext.get().partitionId(), total, most)

        def merged(batches):
            found = sorted((r["part"], r["sums"], r["most"]) for b in batches for r in b.to_pylist())
            if found:
                yield _row(found[0][0], functools.reduce(merge, [np.array(f[1]) for f in found]), np.max([f[2] for f in found], axis=0))

        out = self.df.mapInArrow(partial, "part int, sums array<double>, most array<double>")
        if self.parts is None:
            self.parts = self.df.rdd.getNumPartitions()
        if self.parts > DIRECT:
            each = int(np.ceil(self.parts**0.5))
            out = out.repartition(each, F.floor(F.col("part") / each)).mapInArrow(merged, out.schema)
        found = sorted(((r["part"], r["sums"], r["most"]) for r in out.collect()), key=lambda r: r[0])
        if not found:
            raise ValueError("there are no rows to fit")
        return functools.reduce(merge, [np.array(f[1]) for f in found]), np.max([f[2] for f in found], axis=0)


def _row(part: int, total: np.ndarray, most: np.ndarray) -> pa.RecordBatch:
    kind = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tolist()], kind), pa.array([most.tolist()], kind)], names=["part", "sums", "most"])


def _numpy(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def located(df: DataFrame, columns: list[str], n: int, local_rows: int = LOCAL_ROWS):
    """In memory up to local_rows, else in Spark, where partitions are kept between iterations."""
    if n <= local_rows:
        pdf = df.select(*columns).toPandas()
        return LocalRows({c: pdf[c].to_numpy() for c in columns})
    kept = df.select(*columns).persist()
    return SparkRows(kept, columns, kept)
