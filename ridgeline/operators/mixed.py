"""Gaussian models with a random intercept of any number of levels.

The penalised system is an arrowhead: a small block for the intercept, smooths and linear terms, a diagonal one for the levels, and
what joins them, a row of sums for each level. Levels stay in a table: theirs is one groupBy over partial sums, each trial of
smoothing parameters takes the diagonal block out by its Schur complement, a sum over that table, and effects come and are scored
by joins. Nothing has rows times levels, or levels times levels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linalg, select
from .fit import TARGET, WEIGHT, Design, Options, Statistics, constrain, distinct_values, place, prepared, profile
from .model import GamModel
from .rows import SparkRows, located
from .select import Working
from .terms import Term
from ..functions.families import family

#: Trials of the levels' smoothing parameter that one job makes, and rounds of ever finer ones.
TRIALS, ROUNDS = 15, 5


@dataclass(frozen=True)
class MixedModel:
    """fixed scores all but the levels; effects has level, effect and its standard error given the rest, one row a level."""

    fixed: GamModel
    level: str
    effects: DataFrame
    lam: float
    edf_levels: float
    levels: int
    kept: SparkRows

    def release(self) -> None:
        """Gives back the cache of the levels' sums, which effects are read from; they are made anew if asked for later."""
        self.kept.release()

    def transform(self, df: DataFrame, column: str = "prediction") -> DataFrame:
        """df with the prediction; an unseen or null level counts 0."""
        theirs = self.effects.select(F.col("level").alias("__level"), F.col("effect").alias("__effect"))
        out = self.fixed.transform(df, "link", column).join(theirs, F.col(self.level) == F.col("__level"), "left")
        return out.withColumn(column, F.col(column) + F.coalesce("__effect", F.lit(0.0))).drop("__level", "__effect")


def _level_rows(rows: DataFrame, design: Design, level: str) -> DataFrame:
    """level, w, y, x (sums of weight, of weighted response and of the weighted design), one row for each level and batch."""
    names, p, kind = [*dict.fromkeys(t.name for t in design.terms)], design.p, rows.schema["__level"].dataType.simpleString()
    columns = ["w", "y", *[f"x{i}" for i in range(p)]]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cols = {c: b.column(c).to_numpy(zero_copy_only=False) for c in [TARGET, WEIGHT, *names]}
            w = np.asarray(cols[WEIGHT], np.float64)
            x = design.matrix(cols) if names else np.ones((len(w), 1))
            sums = np.column_stack([w, w * cols[TARGET], w[:, None] * x])
            codes = b.column("__level").dictionary_encode()
            at = codes.indices.fill_null(-1).to_numpy()
            known = at >= 0
            order = np.argsort(at[known], kind="stable")
            first = np.flatnonzero(np.diff(at[known][order], prepend=-1))
            if len(first):
                total = np.add.reduceat(sums[known][order], first, axis=0)
                yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(at[known][order][first])), *[pa.array(c) for c in total.T]], names=["level", *columns])

    partial = rows.mapInArrow(run, f"level {kind}, " + ", ".join(f"{c} double" for c in columns))
    return partial.groupBy("level").agg(*[F.sum(c).alias(c) for c in columns])


def _reduced(table: SparkRows, p: int, lams: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float, float, float]]:
    """For each trial value: what levels take off X'WX, X'Wy and y'Wy, the log determinant of their block, and their degrees of
    freedom given the rest; one job for all."""
    tri = np.triu_indices(p)

    def kernel(cols):
        w, y = np.asarray(cols["w"]), np.asarray(cols["y"])
        x = np.column_stack([cols[f"x{i}"] for i in range(p)])
        out = []
        for v in lams:
            d = w + v
            out += [(x.T @ (x / d[:, None]))[tri], x.T @ (y / d), [(y * y / d).sum(), np.log(d).sum(), (w / d).sum()]]
        return np.concatenate(out), np.zeros(1)

    found = []
    for s in np.split(table.reduce(kernel)[0], len(lams)):
        g = np.zeros((p, p))
        g[tri] = s[: len(tri[0])]
        found.append((g + np.triu(g, 1).T, s[len(tri[0]) : -3], *s[-3:]))
    return found


def fit_mixed(df: DataFrame, target: str, level: str, terms: list[Term] | None = None, weight: str | None = None, opt: Options | None = None) -> MixedModel:
    """A Gaussian fit with a random intercept for each value of `level`. opt.lam: the terms' smoothing parameters and then the levels';
    else all are chosen by restricted likelihood. Rows of null level count towards the rest alone."""
    opt, terms = opt or Options(), terms or []
    if (opt.method or "REML").upper() == "GCV":
        raise ValueError("levels are chosen by restricted likelihood")
    names = [*dict.fromkeys(t.name for t in terms)]
    held = prepared(df, target, terms, weight, opt.na_action, keep={"__level": F.col(level)}).persist()
    p = profile(held, terms)
    rows = SparkRows(held, [TARGET, WEIGHT, *names], held)
    distinct_values(rows, rows.df, terms, p, opt.knots)
    place(terms, p, opt.knots)
    constrain(rows, terms, p.n)
    design, fam = Design(terms), family("gaussian")
    s = Statistics(rows, design, fam).at(None, fam)
    sums = _level_rows(held, design, level).persist()
    names_of = ["w", "y", *[f"x{i}" for i in range(design.p)]]
    table = SparkRows(sums, names_of, sums)
    pen, many = design.penalties, sums.count()
    fixed = None if opt.lam is None else np.asarray(opt.lam, np.float64)

    def at(lam: float, off, rho: np.ndarray | None):
        """The score with the levels' parameter given, the rest at its best; the reduced problem; log lambdas."""
        work = Working(s["g"] - off[0], s["r"] - off[1], s["zz"] - off[2], s["n"])
        rho = np.log(fixed[:-1]) if fixed is not None else select.choose(work, pen, "fREML", "newton", rho)
        return work.reml(pen, rho, None, s["log_weights"]) + 0.5 * (off[3] - many * math.log(lam)), work, rho

    if fixed is not None:
        lam = float(fixed[-1])
        off = _reduced(table, design.p, np.array([lam]))[0]
        score, work, rho = at(lam, off, None)
    else:
        lo, hi, rho = math.log(1e-4), math.log(1e8), None
        for _ in range(ROUNDS):
            grid = np.linspace(lo, hi, TRIALS)
            tried = []
            for v, off in zip(np.exp(grid), _reduced(table, design.p, np.exp(grid))):
                tried.append((*at(v, off, rho), off))
                rho = tried[-1][2]
            j = min(range(TRIALS), key=lambda i: tried[i][0])
            lo, hi = grid[max(j - 1, 0)], grid[min(j + 1, TRIALS - 1)]
            score, work, rho, off = tried[j]
            lam = math.exp(grid[j])
    beta = work.beta(pen, np.exp(rho))
    a = select.ridged(work.g) + pen.total(np.exp(rho))
    inverse = linalg.inverse(a)
    pdev = work.rss(beta) + np.exp(rho) @ pen.quadratic(beta)
    phi = max(pdev / (s["n"] - pen.null), 1e-300)
    b = [float(v) for v in beta]
    gap = F.col("y")
    for i, v in enumerate(b):
        gap = gap - F.lit(v) * F.col(f"x{i}")
    effects = sums.select("level", (gap / (F.col("w") + F.lit(lam))).alias("effect"), F.sqrt(F.lit(phi) / (F.col("w") + F.lit(lam))).alias("se"), F.col("w").alias("weight"))
    # Degrees of freedom: of the rest given the levels, and of the levels: tr of each block of A^-1 X'WX.
    through = _through(table, design.p, lam, inverse)
    model = GamModel(
        terms=terms, fam=fam, target=target, weight=weight, beta=beta, vcov=phi * inverse, lam=np.exp(rho), edf=np.diag(inverse @ work.g), scale=phi, deviance=work.rss(beta), score_value=score,
        method="REML", iterations=1, gram=work.g, rhs=work.r, zz=work.zz, rows=p.n, training={"n": p.n, "mean": p.mean, "lo": p.lo, "hi": p.hi, "y_mean": p.y["mean"]}, reml_scale=phi,
    )
    rows.release()
    return MixedModel(model, level, effects, lam, float(many - lam * through), many, table)


def _through(table: SparkRows, p: int, lam: float, inverse: np.ndarray) -> float:
    """The trace of the levels' block of the whole system's inverse."""

    def kernel(cols):
        d = np.asarray(cols["w"]) + lam
        x = np.column_stack([cols[f"x{i}"] for i in range(p)]) / d[:, None]
        return np.array([(1 / d).sum() + np.einsum("ij,jk,ik->", x, inverse, x)]), np.zeros(1)

    return float(table.reduce(kernel)[0][0])
