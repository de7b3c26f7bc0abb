"""Rows of a smoothed check loss summed by covariates and band of the response, without changing a fit.

The loss, its score and its curvature are analytic in the response: their nearest poles lie pi bandwidths off the real line. Within a
band of a few bandwidths they are their own interpolants at NODES Chebyshev points, up to rounding (3.4^-NODES for BAND bandwidths). So
a band's rows of equal covariates count as those points, weighted by sums over the rows of the points' Lagrange polynomials; some of
these weights are negative. The one thing not analytic is the floor of 1e-10 under working weights, far from the fitted quantile."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fit import COUNT, GROUPED, TARGET, WEIGHT
from .rows import LocalRows, SparkRows, _numpy, located

#: Width of a band in bandwidths, and points that stand for the responses in it.
BAND, NODES = 4.0, 30
#: Groups of sums that a task holds before it hands them on.
HELD = 4096

_ANGLES = np.pi * (np.arange(NODES) + 0.5) / NODES
#: From sums of Chebyshev polynomials to the points' weights.
_WEIGHTS = (2 / NODES) * np.cos(np.outer(np.arange(NODES), _ANGLES)) * np.where(np.arange(NODES) == 0, 0.5, 1.0)[:, None]


def band(target: str, width: float):
    """The band of a response, a column."""
    return F.floor(F.col(target).cast("double") / F.lit(width))


def _polynomials(x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), NODES))
    out[:, 1] = x
    for k in range(2, NODES):
        out[:, k] = 2 * x * out[:, k - 1] - out[:, k - 2]
    return out


def _first_of_each(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order by which equal keys are neighbours, and where each key begins in it."""
    code = np.zeros(len(keys[0]), np.int64)
    for k in keys:
        u, at = np.unique(k, return_inverse=True)
        code = code * len(u) + at
        code = np.unique(code, return_inverse=True)[1] if len(keys) > 2 else code
    order = np.argsort(code, kind="stable")
    c = code[order]
    return order, np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))


def node_rows(data: DataFrame, names: list[str], width: float, about: int, local_rows: int, times: Callable | None = None, many: int = 1, more: list[str] | None = None) -> LocalRows | SparkRows:
    """Rows of TARGET, WEIGHT, names and GROUPED that stand for those of data, about NODES for each of `about` bands; in memory, if few. times: `many`
    weightings of the rows, from their columns (and `more` ones), that come as columns __t0, __t1, ... beside a WEIGHT of 1."""
    read, sums = [TARGET, WEIGHT, *names, *(more or [])], [f"__t{i}" for i in range(many)]

    def partial(batches):
        held, size = [], 0

        def together():
            keys = [np.concatenate([h[0][i] for h in held]) for i in range(len(names) + 1)]
            order, first = _first_of_each(keys)
            total = [np.add.reduceat(np.concatenate([h[i] for h in held])[order], first) for i in (1, 2)]
            return [([k[order[first]] for k in keys], *total)]

        def handed(keys, total, count):
            n = len(count)
            weights = np.einsum("grk,kj->gjr", total, _WEIGHTS).reshape(n * NODES, many)
            at, node = np.repeat(np.arange(n), NODES), np.tile(np.arange(NODES), n)
            cols = [*[k[at] for k in keys], node.astype(np.int32), np.where(node == 0, count[at], 0.0), *weights.T]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=[*names, "__band", "__node", COUNT, *sums])

        for b in batches:
            if not b.num_rows:
                continue
            cols = {c: _numpy(b.column(i)) for i, c in enumerate(read)}
            place = np.asarray(cols[TARGET], np.float64) / width
            low = np.floor(place)
            keys = [np.asarray(cols[c], np.float64) for c in names] + [low]
            order, first = _first_of_each(keys)
            w = np.asarray(cols[WEIGHT], np.float64)[:, None] * (times(cols) if times else 1.0)
            t, w = _polynomials(2 * (place - low) - 1)[order], w[order]
            total = np.stack([np.add.reduceat(t * w[:, r, None], first) for r in range(many)], 1)
            held.append(([k[order[first]] for k in keys], total, np.diff(np.append(first, len(order))).astype(np.float64)))
            size += len(first)
            if size > HELD:
                held = together()
                size = len(held[0][2])
                if 2 * size > HELD:
                    yield handed(*held[0])
                    held, size = [], 0
        if held:
            yield handed(*together()[0])

    schema = ", ".join([*[f"`{c}` double" for c in names], "__band double, __node int", *[f"{c} double" for c in (COUNT, *sums)]])
    each = data.select(*read).mapInArrow(partial, schema).groupBy(*names, "__band", "__node").agg(*[F.sum(c).alias(c) for c in (COUNT, *sums)])
    at = (F.col("__band") + (1 + F.cos((F.col("__node") + 0.5) * F.lit(math.pi / NODES))) / 2) * F.lit(width)
    weight = F.when(F.col("__t0") == 0, 1e-200).otherwise(F.col("__t0")) if times is None else F.lit(1.0)
    out = each.select(at.alias(TARGET), weight.alias(WEIGHT), *names, COUNT, *[F.lit(0.0).alias(c) for c in GROUPED[1:]], *(sums if times else []))
    return located(out, out.columns, about * NODES, local_rows)
