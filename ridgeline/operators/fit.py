"""Fitting: profile the columns, prepare the terms, and iterate one statistics job a step."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.families import Binomial, Gamma, Gaussian, InverseGaussian, NegBin, OrderedCategorical, Poisson, Quantile, StudentT, Tweedie, Family, family as make_family
from ..functions.ops import NP, SP
from . import linalg, select
from .diagnostics import order_statistics
from .model import GamModel
from .rows import LOCAL_ROWS, SparkRows, located
from .select import Penalties, Working
from .terms import LEAST_K, BSpline, Cubic, Linear, RandomEffect, Term, ThinPlate

TARGET, WEIGHT = "__y", "__w"
#: Beside them in rows that stand for several: how many, the sum of their log weights, and what their responses vary by among
#: themselves, as a weighted sum of squares and as deviance.
COUNT, LOG_WEIGHTS, SPREAD, WITHIN = GROUPED = "__n", "__lw", "__ss", "__within"
#: Rows that a tuple of covariates must stand for, on average, for rows to be summed by tuple first.
WORTH = 4
#: Shares of a step at which the deviance is taken beside the sums at its end, so that a step too long is shortened at once; the
#: first is where the step began.
SHARES = (0.0, 0.5, 0.25, 0.125, 2.0**-5, 2.0**-8, 2.0**-14)
#: A longer step, whose deviance comes with theirs.
LONGER = 4.0


@dataclass
class Options:
    """method: REML, fREML or GCV. algorithm: newton or fellner-schall. lam fixes the smoothing parameters.
    exact: optimise the Laplace score itself; else smoothing parameters follow the working problem of each step.
    qr: steps come from a triangular factor of the rows, merged over partitions, instead of X'WX."""

    method: str | None = None
    algorithm: str | None = None
    lam: list[float] | None = None
    exact: bool = True
    discrete: bool = False
    knots: str = "quantile"
    most_iterations: int = 100
    tol: float = 1e-7
    local_rows: int = LOCAL_ROWS
    na_action: str = "fail"
    profile_p: bool = False
    qr: bool = False


@dataclass
class Profile:
    n: int
    weight: float
    lo: dict[str, float]
    hi: dict[str, float]
    unique: dict[str, int]
    about: dict[str, int] = field(default_factory=dict)
    tuples: dict[str, int] = field(default_factory=dict)
    knots: dict[str, np.ndarray] = field(default_factory=dict)
    levels: dict[str, list] = field(default_factory=dict)
    mean: dict[str, float] = field(default_factory=dict)
    y: dict[str, float] = field(default_factory=dict)


def prepared(df: DataFrame, target: str, terms: list[Term], weight: str | None, na_action: str, keep: dict | None = None) -> DataFrame:
    """The columns of a fit, numbers as doubles, and further ones to keep; columns missing from df are named."""
    missing = [c for c in [target, *[t.name for t in terms], *([weight] if weight else [])] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    cols = [F.col(target).cast("double").alias(TARGET), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias(WEIGHT)]
    seen = set()
    for t in terms:
        if t.name not in seen:
            seen.add(t.name)
            cols.append(F.col(t.name) if t.kind == "re" and not isinstance(df.schema[t.name].dataType, NumericType) else F.col(t.name).cast("double").alias(t.name))
    out = df.select(*cols, *[e.alias(c) for c, e in (keep or {}).items()])
    if na_action == "omit":
        needed = [c for c in out.columns if c not in (keep or {})]
        out = out.dropna(subset=needed)
        for c, kind in out.dtypes:
            out = out.where(~F.isnan(c)) if kind == "double" and c in needed else out
    return out


#: Levels of a random effect that a dense block may have; mixed.fit_mixed takes any number.
MOST_LEVELS = 2000
#: Distinct values of a column, about, up to which one task sorts them for their quantiles; beyond, each quantile is bracketed first,
#: by ranks that are off by 1 in ACCURACY at most, and found among the values in its bracket.
EXACT_DISTINCT, ACCURACY = 1_000_000, 100_000


def profile(data: DataFrame, terms: list[Term]) -> Profile:
    """One aggregation without distinct or sort: counts, ranges, means, validity."""
    numbers = [t for t in terms if t.kind != "re"]
    agg = [F.count("*").alias("n"), F.sum(WEIGHT).alias("w"), F.min(WEIGHT).alias("wmin"), F.max(WEIGHT).alias("wmax"), F.count(TARGET).alias("ny"),
           F.max(F.isnan(TARGET).cast("int")).alias("ynan"), F.avg(TARGET).alias("ymean"), F.var_samp(TARGET).alias("yvar"), F.min(TARGET).alias("ymin"), F.max(TARGET).alias("ymax"), F.sum(TARGET).alias("ysum"), F.min(F.when(F.col(TARGET) > 0, F.col(TARGET))).alias("ypos")]
    agg += [e.alias(k) for k, e in _tuples(terms).items()]
    for i, t in enumerate(numbers):
        agg += [F.approx_count_distinct(t.name).alias(f"u{i}")] if t.penalised else []
        agg += [F.min(t.name).alias(f"lo{i}"), F.max(t.name).alias(f"hi{i}"), F.avg(t.name).alias(f"m{i}"), F.count(t.name).alias(f"c{i}"), F.max(F.isnan(t.name).cast("int")).alias(f"nan{i}")]
    r = data.agg(*agg).first()
    if not r["n"]:
        raise ValueError("there are no rows to fit")
    if r["ny"] < r["n"] or r["ynan"]:
        raise ValueError("the response has nulls or NaN; use na_action='omit'")
    if r["wmin"] is None or not r["wmin"] > 0 or not math.isfinite(r["wmax"]):
        raise ValueError("weights must be finite and positive")
    out = Profile(r["n"], r["w"], {}, {}, {}, y={"mean": r["ymean"], "var": r["yvar"] or 0.0, "min": r["ymin"], "max": r["ymax"], "sum": r["ysum"], "positive": r["ypos"]}, tuples={k: r[k] for k in _tuples(terms)})
    for i, t in enumerate(numbers):
        if r[f"c{i}"] < r["n"] or r[f"nan{i}"]:
            raise ValueError(f"column {t.name} has nulls or NaN; use na_action='omit'")
        if t.penalised:
            out.about[t.name] = r[f"u{i}"]
        out.lo[t.name], out.hi[t.name], out.mean[t.name] = r[f"lo{i}"], r[f"hi{i}"], r[f"m{i}"]
    return out


def _tuples(terms: list[Term]) -> dict[str, F.Column]:
    """About how many tuples of covariates there are, and of covariates and response."""
    names = list(dict.fromkeys(t.name for t in terms))
    return {"moments": F.approx_count_distinct(F.xxhash64(*names)), "values": F.approx_count_distinct(F.xxhash64(*names, TARGET))} if names else {}


def grouping(fam: Family, profile_p: bool) -> str | None:
    """How rows of equal covariates may be summed without changing a fit. Where score and curvature are linear in the response, and
    the deviance is but for what the linear predictor doesn't touch, their mean, weight and spread stand for them (moments); families
    that are not, or whose shape is looked for, need rows of equal responses (values)."""
    if isinstance(fam, (Gaussian, Binomial, Poisson, Gamma, InverseGaussian)) or (isinstance(fam, Tweedie) and not profile_p):
        return "moments"
    return "values" if isinstance(fam, (NegBin, StudentT, OrderedCategorical)) else None


def summed(data: DataFrame, keys: list[str], fam: Family, how: str, mean: float) -> DataFrame:
    """A row for each tuple of keys (and response, by values): mean response, weight and GROUPED. Partial sums come before the
    shuffle, so a tuple with most rows is no burden."""
    y, w = F.col(TARGET), F.col(WEIGHT)
    shared = {COUNT: F.count("*").cast("double"), LOG_WEIGHTS: F.sum(F.log(w)), WEIGHT: F.sum(w)}
    if how == "values":
        out = data.groupBy(*keys, TARGET).agg(*[e.alias(k) for k, e in shared.items()]).withColumns({SPREAD: F.lit(0.0), WITHIN: F.lit(0.0)})
    else:
        # About a middle value, so that little is lost to rounding.
        middle = float(fam.start(NP, mean))
        d, m = y - middle, F.lit(middle)
        sums = shared | {"__d": F.sum(w * d), "__dd": F.sum(w * d * d), "__dev": F.sum(w * fam.deviance(SP, y, m))}
        out = data.groupBy(*keys).agg(*[e.alias(k) for k, e in sums.items()]).withColumn(TARGET, middle + F.col("__d") / w)
        out = out.withColumn(SPREAD, F.greatest(F.col("__dd") - F.col("__d") * F.col("__d") / w, F.lit(0.0))).withColumn(WITHIN, F.col("__dev") - w * fam.deviance(SP, y, m))
    return out.select(TARGET, WEIGHT, *keys, *GROUPED)


def distinct_values(rows, data: DataFrame, terms: list[Term], p: Profile, knots: str) -> None:
    """Distinct counts, quantile knots and levels. In Spark a column's distinct values are found first, with partial sums on the
    map side, and quantiles taken of them; columns of up to EXACT_DISTINCT of them share one job."""
    together = []
    for t in terms:
        probs = [i / (t.k - 1) for i in range(t.k)] if t.kind in ("cr", "tps") and t.k > 1 and knots == "quantile" else None
        if hasattr(rows, "columns"):
            values = rows.columns[t.name]
            if t.kind == "re":
                p.levels[t.name] = sorted({v for v in values.tolist() if v is not None and v == v})
            elif t.penalised:
                u = np.unique(np.asarray(values, np.float64))
                p.unique[t.name] = len(u)
                if probs:
                    p.knots[t.name] = np.quantile(u, probs)
        elif t.kind == "re":
            p.levels[t.name] = sorted(x[0] for x in data.select(t.name).distinct().limit(MOST_LEVELS + 2).collect() if x[0] is not None)
        elif t.penalised and p.about[t.name] <= EXACT_DISTINCT:
            together.append((t.name, probs))
        elif t.penalised:
            p.unique[t.name], found = bracketed_quantiles(data, t.name, probs or [])
            if probs:
                p.knots[t.name] = found
    if together:
        alone = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("u")) for i, c in enumerate(dict.fromkeys(c for c, _ in together))])
        where = {c: i for i, c in enumerate(dict.fromkeys(c for c, _ in together))}
        values = data.select(F.explode(alone).alias("s")).select("s.i", "s.u").distinct()
        found = values.agg(*[e for j, (c, probs) in enumerate(together) for e in _counted(F.when(F.col("i") == where[c], F.col("u")), j, probs)]).first()
        for j, (c, probs) in enumerate(together):
            p.unique[c] = found[f"n{j}"]
            if probs:
                p.knots[c] = np.array(found[f"q{j}"], np.float64)


def _counted(value, j: int, probs: list[float] | None) -> list:
    return [F.count(value).alias(f"n{j}"), *([F.percentile(value, F.array(*map(F.lit, probs))).alias(f"q{j}")] if probs else [])]


def bracketed_quantiles(data: DataFrame, name: str, probs: list[float]) -> tuple[int, np.ndarray]:
    """The number of distinct values and their exact quantiles, interpolated between neighbours. No task holds more than the values
    in a bracket around each, a few in ACCURACY of all; a bracket that misses its ranks is widened."""
    u = data.select(F.col(name).alias("u")).where(F.col("u").isNotNull()).distinct()
    if not probs:
        return u.count(), np.zeros(0)
    margin = 2 / ACCURACY
    while True:
        edges = [min(max(q + s * margin, 0.0), 1.0) for q in probs for s in (-1, 1)]
        r = u.agg(F.count("u").alias("n"), F.percentile_approx("u", edges, ACCURACY).alias("q"), F.min("u").alias("lo"), F.max("u").alias("hi")).first()
        n, brackets = r["n"], []
        for i, q in enumerate(probs):
            brackets.append((r["lo"] if q - margin <= 0 else r["q"][2 * i], r["hi"] if q + margin >= 1 else r["q"][2 * i + 1]))
        agg = [e for i, (a, b) in enumerate(brackets) for e in (F.sum((F.col("u") < F.lit(a)).cast("long")).alias(f"below{i}"), F.collect_list(F.when(F.col("u").between(a, b), F.col("u"))).alias(f"in{i}"))]
        got, out = u.agg(*agg).first(), []
        for i, q in enumerate(probs):
            at, inside = q * (n - 1), np.sort(np.array(got[f"in{i}"], np.float64))
            first, last = math.floor(at) - got[f"below{i}"], math.ceil(at) - got[f"below{i}"]
            if first < 0 or last >= len(inside):
                break
            out.append(inside[first] + (at - math.floor(at)) * (inside[last] - inside[first]))
        if len(out) == len(probs):
            return n, np.array(out)
        margin *= 4


def resolve_k(t: Term, unique: int) -> int:
    """k within [least, distinct values - 1]; a change is warned of."""
    least = LEAST_K[t.kind]
    k = max(least, min(t.k, unique - 1))
    if k != t.k:
        warnings.warn(f"k of {t.name} set to {k} from {t.k}: the column has {unique} distinct values", stacklevel=3)
    return k


def place(terms: list[Term], p: Profile, knots: str) -> None:
    """Knots and levels of the terms, from the profile."""
    for t in terms:
        if isinstance(t, RandomEffect):
            t.levels = p.levels[t.name]
        elif not isinstance(t, Linear):
            k, lo, hi = resolve_k(t, p.unique[t.name]), p.lo[t.name], p.hi[t.name]
            even = np.linspace(lo, hi if hi > lo else lo + 1, k)
            quantiles = p.knots.get(t.name)
            t.k = k
            if isinstance(t, (Cubic, ThinPlate)):
                t.knots = quantiles if quantiles is not None and len(quantiles) == k and len(np.unique(quantiles)) == k else even
                if isinstance(t, ThinPlate):
                    t.knots = t.knots[1:-1] if k > 3 else t.knots
            elif isinstance(t, BSpline):
                t.lo, t.hi = lo, hi if hi > lo else lo + 1


class Design:
    """[1, term blocks] and its penalties."""

    def __init__(self, terms: list[Term], constrained: bool = True):
        self.terms = terms
        self.slices, at = [], 1
        for t in terms:
            self.slices.append(slice(at, at + t.size))
            at += t.size
        self.p = at
        self.smooth = [i for i, t in enumerate(terms) if t.penalised]
        self.penalties = Penalties(at, [(self.slices[i], terms[i].s) for i in self.smooth])

    def matrix(self, cols: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(cols.values())))
        out = np.empty((n, self.p))
        out[:, 0] = 1.0
        for t, at in zip(self.terms, self.slices):
            out[:, at] = _looked_up(t.block, np.asarray(cols[t.name])) if t.kind not in ("re", "parametric") else t.block(np.asarray(cols[t.name]))
        return out


def _looked_up(f, x: np.ndarray) -> np.ndarray:
    """f by row, worked out once for each distinct value where these are few, as in cells."""
    if len(x) < 256:
        return f(x)
    u, at = np.unique(x, return_inverse=True)
    return f(u)[at] if 2 * len(u) < len(x) else f(x)


def constrain(rows, terms: list[Term], n: int) -> None:
    """Column sums and the largest row norm of every raw basis, in one job; then each term's constraint."""
    raw = [t for t in terms if t.kind not in ("re", "parametric")]

    def kernel(cols):
        b = [_looked_up(t.basis, np.asarray(cols[t.name], np.float64)) for t in raw]
        times = np.asarray(cols[COUNT]) if COUNT in cols else None
        return np.concatenate([x.sum(0) if times is None else times @ x for x in b]), np.array([np.abs(x).sum(1).max(initial=0) for x in b])

    if not raw:
        sums, most = np.zeros(0), np.zeros(0)
    else:
        sums, most = rows.column_sums(raw) if hasattr(rows, "column_sums") else rows.reduce(kernel)
    at = 0
    for t, norm in zip(raw, most):
        width = len(t.penalty())
        t.prepare(sums[at : at + width], n, float(norm))
        at += width
    for t in terms:
        if t.kind in ("re", "parametric"):
            t.prepare(np.zeros(0), n, 1.0)


class Statistics:
    """Sums at a coefficient vector, one job each: G = X'WX, r = X'(w eta + g), deviance, z'Wz and validity."""

    def __init__(self, rows, design: Design, fam: Family, single=None, qr: bool = False):
        """single: the rows before they were summed by tuple, for what a tuple's mean doesn't tell. qr: steps have the triangular factor of
        [sqrt W X, sqrt W z] too, from the same job."""
        self.qr = qr
        self.rows, self.design, self.fam, self.profile_p, self.single = rows, design, fam, False, single or rows

    def at(self, beta: np.ndarray | None, fam: Family | None = None, newton: bool = False, extra=None, old: np.ndarray | None = None) -> dict:
        """beta None: from the starting values of the response. newton: with the observed curvature, which may fall below 0. extra: further sums of (y, eta, w). old: coefficients that
        the step to beta began at; the deviance at SHARES of it, and at LONGER, comes as line."""
        fam, design, qr = fam or self.fam, self.design, self.qr and not newton

        def kernel(cols):
            w0 = np.asarray(cols[WEIGHT], np.float64)
            return _sums_at(design.matrix(cols), np.asarray(cols[TARGET], np.float64), w0, beta, fam, newton, extra, _grouped(cols), old, qr), np.zeros(1)

        if not qr:
            return self._unpacked(self.rows.reduce(kernel)[0], old is not None)
        side = design.p + 1
        sums, factor = np.split(self.rows.reduce(kernel, _merged_factors(side))[0], [-side * side])
        return {**self._unpacked(sums, old is not None), "factor": factor.reshape(side, side)}

    def at_each(self, betas: dict[int, tuple[np.ndarray, np.ndarray | None]], times: Callable[[dict[str, np.ndarray]], np.ndarray], fams: list[Family] | None = None) -> dict[int, dict]:
        """For several weightings of the rows, each at coefficients (and old ones, and a family) of its own, in one job. times: by row and weighting."""
        design, which = self.design, sorted(betas)
        fams = {i: fams[i] if fams else self.fam for i in which}

        def kernel(cols):
            x, y, w0, m = design.matrix(cols), np.asarray(cols[TARGET], np.float64), np.asarray(cols[WEIGHT], np.float64), times(cols)
            out, grouped = [], _grouped(cols)
            for i in which:
                on = m[:, i] != 0
                more = grouped and {k: v[on] for k, v in grouped.items()}
                out.append(_sums_at(x[on], y[on], w0[on] * m[on, i], betas[i][0], fams[i], grouped=more, old=betas[i][1]))
            return np.concatenate(out), np.zeros(1)

        total, size = self.rows.reduce(kernel)[0], design.p * (design.p + 1) // 2 + design.p + 4
        ends = np.cumsum([size + (len(SHARES) + 1 if betas[i][1] is not None else 0) for i in which])[:-1]
        return {i: self._unpacked(s, betas[i][1] is not None) for i, s in zip(which, np.split(total, ends))}

    def _unpacked(self, s: np.ndarray, line: bool = False) -> dict:
        p = self.design.p
        tri = np.triu_indices(p)
        m = len(tri[0])
        gram = np.zeros((p, p))
        gram[tri] = s[:m]
        gram = gram + np.triu(gram, 1).T
        d, zz, n, lw = s[m + p : m + p + 4]
        end = m + p + 4 + (len(SHARES) + 1 if line else 0)
        return {"g": gram, "r": s[m : m + p], "dev": float(d), "zz": float(zz), "n": float(n), "log_weights": float(lw), "line": s[m + p + 4 : end], "extra": s[end:]}

    def leverage_slope(self, beta: np.ndarray, fam: Family, inverse: np.ndarray) -> np.ndarray:
        """Sum over rows of x (x' inverse x) dw/d eta: what the log determinant of X'WX + S gains as coefficients move."""
        design = self.design

        def kernel(cols):
            x, y, w0 = design.matrix(cols), np.asarray(cols[TARGET], np.float64), np.asarray(cols[WEIGHT], np.float64)
            slope = w0 * fam.curvature_slope(NP, y, x @ beta)
            return x.T @ (slope * np.einsum("ij,ij->i", x @ inverse, x)), np.zeros(1)

        return self.rows.reduce(kernel)[0]

    def likelihood(self, fam: Family) -> np.ndarray:
        def kernel(cols):
            return fam.likelihood_sums(np.asarray(cols[TARGET], np.float64), np.asarray(cols[WEIGHT], np.float64)), np.zeros(1)

        # Linear in the weight at each response: rows that are summed by value will do.
        rows = self.rows if isinstance(fam, (NegBin, StudentT)) else self.single
        return rows.reduce(kernel)[0]

    def pearson(self, beta: np.ndarray, fam: Family) -> float:
        """Pearson's statistic."""
        design = self.design

        def kernel(cols):
            y, w, more = np.asarray(cols[TARGET], np.float64), np.asarray(cols[WEIGHT], np.float64), _grouped(cols)
            mu = fam.link.safe_mu(NP, fam.link.inverse(NP, design.matrix(cols) @ beta))
            off = w * (y - mu) ** 2 + (more[SPREAD] if more else 0.0)
            return np.array([(off / fam.variance(NP, mu)).sum()]), np.zeros(1)

        return float(self.rows.reduce(kernel)[0][0])


def _grouped(cols: dict) -> dict[str, np.ndarray] | None:
    return {k: np.asarray(cols[k], np.float64) for k in GROUPED} if COUNT in cols else None


def _sums_at(x, y, w0, beta, fam: Family, newton: bool = False, extra=None, grouped: dict | None = None, old: np.ndarray | None = None, qr: bool = False) -> np.ndarray:
    eta = fam.link.link(NP, fam.start(NP, y)) if beta is None else x @ beta
    one, g = fam.working(NP, y, eta)
    one = fam.observed(NP, y, eta) if newton else one
    w, g = w0 * one, w0 * g
    z = eta + g / np.where(np.abs(w) < 1e-10 * w0, 1e-10 * w0, w)
    dev, zz, n, log_weights = (w0 * fam.deviance_eta(NP, y, eta)).sum(), (w * z * z).sum(), float(len(y)), 0.0
    if grouped is None:
        log_weights = np.log(w0).sum()
    else:
        dev, n, log_weights = dev + grouped[WITHIN].sum(), grouped[COUNT].sum(), grouped[LOG_WEIGHTS].sum()
        if grouped[SPREAD].any():  # the score is linear in the response
            per_unit = fam.working(NP, y + 1.0, eta, False)[1] - fam.working(NP, y, eta, False)[1]
            zz += (grouped[SPREAD] * per_unit**2 / one).sum()
    line = np.zeros(0)
    if old is not None:
        begin, within = x @ old, grouped[WITHIN].sum() if grouped else 0.0
        line = np.array([(w0 * fam.deviance_eta(NP, y, begin + a * (eta - begin))).sum() + within for a in (*SHARES, LONGER)])
    gram = x.T @ (w[:, None] * x)
    more = extra(y, eta, w0) if extra else np.zeros(0)
    factor = linalg.stacked_r([np.sqrt(np.maximum(w, 0))[:, None] * np.column_stack([x, z])]).ravel() if qr else np.zeros(0)
    return np.concatenate([gram[np.triu_indices(x.shape[1])], x.T @ (w * eta + g), [dev, zz, n, log_weights], line, more, factor])


def _merged_factors(side: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Adds statistics up, but for the triangular factor at their end: that of both factors' rows."""
    def merge(a, b):
        at = len(a) - side * side
        return np.concatenate([a[:at] + b[:at], linalg.stacked_r([a[at:].reshape(side, side), b[at:].reshape(side, side)]).ravel()])

    return merge


def pirls(stats: Statistics, fam: Family, lam: np.ndarray, beta: np.ndarray | None, opt: Options) -> tuple[np.ndarray, dict, int]:
    """Penalised iteration at fixed smoothing parameters, one job a step; a step that raises the penalised deviance takes a second
    job, at the largest of SHARES that doesn't; one that is still far off takes it at LONGER."""
    run = _pirls_asks(stats.design.penalties, lam, beta, opt)
    asked = next(run)
    while True:
        try:
            asked = run.send(stats.at(asked[0], fam, old=asked[1]))
        except StopIteration as end:
            return end.value


def pirls_each(stats: Statistics, lam: np.ndarray, beta: np.ndarray, opt: Options, times, n: int, fams: list[Family] | None = None) -> list[np.ndarray]:
    """Coefficients of the iteration under each of n weightings of the rows (and families, if given), side by side: a step of all is one job."""
    runs = [_pirls_asks(stats.design.penalties, lam, beta, opt) for _ in range(n)]
    asked, out = {i: next(run) for i, run in enumerate(runs)}, [beta] * n
    while asked:
        for i, s in stats.at_each(asked, times, fams).items():
            try:
                asked[i] = runs[i].send(s)
            except StopIteration as end:
                out[i] = end.value[0]
                del asked[i]
    return out


def _pirls_asks(pen: Penalties, lam: np.ndarray, beta: np.ndarray | None, opt: Options):
    """The iteration itself: yields coefficients and those the step began at, and is sent the statistics there. A search from given
    coefficients that comes to a halt far off (see _halted) begins again, once, at the response's starting values, with one job in
    place of the shortened step's; the better end of both counts. A step is lengthened where that halves the penalised deviance."""
    s = yield beta, None
    total = pen.total(lam)
    given, left = beta is not None, None
    old = s["dev"] + beta @ total @ beta if given else math.inf
    for it in range(1, opt.most_iterations + 1):
        new = select.working(s).beta(pen, lam)
        after = yield new, beta
        value = after["dev"] + new @ total @ new
        if beta is not None and not value <= old + 10 * (0.1 + abs(old)) * np.finfo(float).eps ** 0.5:
            short, reached, share = _shortened(beta, new, after["line"], lambda b: b @ total @ b, old)
            if given and left is None and _halted(share, reached, old):
                left = old, beta, s
                beta, s, old = None, (yield None, None), math.inf
                continue
            new = short
            after = yield new, None
            value = after["dev"] + new @ total @ new
        elif beta is not None:
            far = beta + LONGER * (new - beta)
            if value > 1e-6 * after["n"] and after["line"][-1] + far @ total @ far < 0.5 * value:  # separable rows: the optimum is far off
                new = far
                after = yield new, None
                value = after["dev"] + new @ total @ new
        done = beta is not None and (np.abs(new - beta).max() < 1e-9 * (1 + np.abs(new).max()) or abs(old - value) < 1e-12 * (abs(value) + 0.1))
        beta, s, old = new, after, value
        if done:
            break
    if left is not None and (beta is None or not old <= left[0]):
        old, beta, s = left
    return beta, s, it


def _shortened(beta: np.ndarray, new: np.ndarray, line: np.ndarray, penalty, before: float) -> tuple[np.ndarray, float, float]:
    """The largest share of a step that doesn't raise the penalised deviance (the smallest, if all do): coefficients, what they reach, share."""
    for a, dev in zip(SHARES[1:], line[1:]):
        at = beta + a * (new - beta)
        reached = dev + penalty(at)
        if reached <= before + 1e-8 * (abs(before) + 1):
            break
    return at, reached, a


def _halted(share: float, reached: float, before: float) -> bool:
    """Whether only the smallest share of a step is left, where the penalised deviance still changes: working weights have all but
    vanished, so steps are of no sound length. At an optimum rounding shortens steps too, but little changes there."""
    return share == SHARES[-1] and abs(reached - before) > 1e-6 * (abs(before) + 1)


def laplace(fam: Family, pen: Penalties, rho: np.ndarray, beta: np.ndarray, s: dict, sums: np.ndarray, curvature: np.ndarray) -> tuple[float, float]:
    """Laplace restricted likelihood score at a converged fit, and the scale."""
    lam = np.exp(rho)
    pdev = s["dev"] + lam @ pen.quadratic(beta)
    phi = fam.scale(pdev, s["n"], pen.null, sums)
    half = 0.5 * (linalg.logdet(select.ridged(curvature) + pen.total(lam)) - pen.logdet(lam))
    return pdev / (2 * phi) - fam.saturated(phi, s["n"], sums) + half - pen.null / 2 * math.log(2 * math.pi * phi), phi


def fit_gam(df: DataFrame, target: str, terms: list[Term], fam: Family | str = "gaussian", weight: str | None = None, opt: Options | None = None, profile_shape: bool = True) -> GamModel:
    """A fitted model. Gaussian fits take two jobs whatever the search for smoothing parameters; others one job a step. Where
    covariates repeat, rows are summed by tuple first (see grouping()), and all steps read those sums alone."""
    opt = opt or Options()
    fam = make_family(fam) if isinstance(fam, str) else fam
    method = opt.method or ("fREML" if isinstance(fam, StudentT) else "REML")
    data = prepared(df, target, terms, weight, opt.na_action)
    p = profile(data, terms)
    columns = [TARGET, WEIGHT, *dict.fromkeys(t.name for t in terms)]
    rounded, how = opt.discrete and p.n >= 2000, None if opt.qr else grouping(fam, opt.profile_p)
    single = None

    def by_tuple(df: DataFrame, tuples: int):
        """Rows summed by tuple, if that leaves few."""
        if how and tuples * WORTH <= p.n:
            return located(summed(df, columns[2:], fam, how, p.y["mean"]), [*columns, *GROUPED], tuples, opt.local_rows)

    rows = None if rounded or not p.tuples else by_tuple(data, p.tuples[how] if how else 0)
    if rows is not None:
        single = SparkRows(data, columns)
    else:
        rows = located(data, columns, p.n, opt.local_rows)
    distinct_values(rows, getattr(rows, "df", data), terms, p, opt.knots)
    for t in terms:
        if len(p.levels.get(t.name, ())) > MOST_LEVELS:
            raise ValueError(f"{t.name} has over {MOST_LEVELS} levels: use operators.mixed.fit_mixed")
    place(terms, p, opt.knots)
    _warn_rare(fam, p, terms)
    held, cells = [rows], None
    if rounded:
        from .binning import Cells, binned_rows

        rows = binned_rows(rows, [t for t in terms if t.kind not in ("re", "parametric")], p)
        if fam.name == "gaussian" and not opt.qr and isinstance(rows, SparkRows) and any(t.kind != "parametric" for t in terms):
            cells = Cells(rows, terms, TARGET, WEIGHT)
            held.append(cells)
        elif isinstance(rows, SparkRows) and terms and how:
            few = by_tuple(rows.df, rows.df.agg(_tuples(terms)[how]).first()[0])
            if few is not None:
                single, rows = rows, few
                held.append(few)
    constrain(cells or rows, terms, p.n)
    design = Design(terms)
    stats = Statistics(rows, design, fam, single, opt.qr)
    stats.profile_p = opt.profile_p
    pen = design.penalties
    algorithm = opt.algorithm or ("fellner-schall" if isinstance(fam, Quantile) else "newton")
    fixed = None if opt.lam is None else np.log(np.broadcast_to(np.asarray(opt.lam, np.float64), (len(pen.blocks),)).copy())
    fam = _seeded(fam, p, stats)
    if fam.name == "gaussian":
        s = cells.statistics(design) if cells else stats.at(None, fam)
        work = select.working(s)
        rho = fixed if fixed is not None else select.choose(work, pen, method, algorithm)
        beta = work.beta(pen, np.exp(rho))
        final = stats.at(beta, fam) if work.rss(beta) < 1e-10 * work.zz else {**s, "dev": work.rss(beta)}
        score = work.reml(pen, rho, None, s["log_weights"])
        phi, iterations = max((final["dev"] + np.exp(rho) @ pen.quadratic(beta)) / (s["n"] - pen.null), 1e-300), 1
    else:
        beta, rho, s, fam, score, phi, iterations = _iterate(stats, fam, pen, method, algorithm, fixed, opt, p, profile_shape)
        final = s
        work = select.working(s)
    lam = np.exp(rho)
    edf = work.edf(pen, lam)
    scale = 1.0 if fam.known_scale else _reported_scale(fam, stats, beta, final, edf.sum())
    for part in reversed(held):  # what was made of others first
        if hasattr(part, "release"):
            part.release()
    kept = {"n": p.n, "mean": p.mean, "lo": p.lo, "hi": p.hi, "y_mean": p.y["mean"]}
    return GamModel(
        terms=terms, fam=fam, target=target, weight=weight, beta=beta, vcov=scale * work.inverse(pen, lam), lam=lam, edf=edf, scale=scale, deviance=final["dev"], score_value=score,
        method=method, iterations=iterations, gram=work.g, rhs=work.r, zz=work.zz, rows=p.n, training=kept, reml_scale=phi,
    )


def _reported_scale(fam: Family, stats: Statistics, beta: np.ndarray, s: dict, edf: float) -> float:
    """Gaussian: RSS over residual degrees; other families: Pearson's statistic over them."""
    if fam.name == "gaussian":
        return s["dev"] / max(s["n"] - edf, 1e-8)
    return stats.pearson(beta, fam) / max(s["n"] - edf, 1e-8)


def _warn_rare(fam: Family, p: Profile, terms: list[Term]) -> None:
    free = sum(t.k - 1 for t in terms if t.penalised and t.kind != "re")
    events = min(p.y["sum"], p.n - p.y["sum"]) if fam.name == "binomial" else math.inf
    if free and events / free < 5:
        warnings.warn(f"{events:.0f} events for {free} basis coefficients: fewer than 5 for each", stacklevel=3)


def _seeded(fam: Family, p: Profile, stats: Statistics) -> Family:
    if isinstance(fam, StudentT):
        return replace(fam, sigma2=max(0.5 * p.y["var"], 1e-12))
    if isinstance(fam, Quantile) and fam.sigma == 1.0 and fam.co == 0.1:
        s2, t = max(p.y["var"], 1e-12), fam.tau
        sigma = 0.05 * math.sqrt(2 * math.pi * s2) / (2 * math.log(2)) * max(1.0, 1 / (4 * t * (1 - t)))
        return replace(fam, sigma=sigma, co=sigma)
    if isinstance(fam, Tweedie) and p.y["positive"]:
        return replace(fam, span=(math.log(p.y["positive"]), math.log(p.y["max"])))
    if isinstance(fam, OrderedCategorical):
        r = fam.classes

        def counts(cols):
            y = np.rint(np.asarray(cols[TARGET], np.float64))
            times = _grouped(cols)[COUNT] if COUNT in cols else np.ones(len(y))
            return np.array([times[y == i].sum() for i in range(1, r + 1)], np.float64), np.zeros(1)

        c = stats.rows.reduce(counts)[0]
        if c.sum() < p.n:
            raise ValueError(f"ocat needs classes 1 to {r}")
        share = np.clip(np.cumsum(c)[:-1] / c.sum(), 1e-4, 1 - 1e-4)
        cut = np.log(share / (1 - share))
        return replace(fam, theta=tuple(float(np.log(max(g, 1e-2))) for g in np.diff(cut)))
    return fam



def _iterate(stats, fam, pen, method, algorithm, fixed, opt, p: Profile, profile_shape):
    """Non-Gaussian fits. Each step solves the working problem, and lets smoothing parameters, scale and shape follow it; the exact
    score is then optimised from there if asked for."""
    sums = stats.likelihood(fam)
    s, beta, rho, phi = stats.at(None if not isinstance(fam, (StudentT, Quantile, OrderedCategorical)) else _first(stats, fam, p), fam), None, fixed, 1.0
    old, it, log_phi = math.inf, 0, None
    joint = method == "fREML" and algorithm == "newton" and len(pen.blocks) > 0
    for it in range(1, opt.most_iterations + 1):
        work = select.working(s)
        if fixed is not None:
            new_rho = fixed
        elif joint:  # one step in smoothing parameters and scale for each step in the coefficients
            begin = select.start(work, pen) if rho is None else rho
            if not fam.known_scale and log_phi is None:
                log_phi = work.best_log_phi(pen, begin)
            new_rho, log_phi = work.freml_step(pen, begin, None if fam.known_scale else log_phi)
        else:
            new_rho = select.choose(work, pen, method, algorithm, rho, 1.0 if fam.known_scale else None)
        lam = np.exp(new_rho)
        new = work.beta(pen, lam)
        extra = _shape_sums(fam) if profile_shape else None
        after = stats.at(new, fam, extra=extra, old=beta)
        rough = lambda b: lam @ pen.quadratic(b)
        value = after["dev"] + rough(new)
        base = math.inf if beta is None else after["line"][0] + rough(beta)
        if beta is not None and not value <= base + 1e-6 * (abs(base) + 1):
            new = _shortened(beta, new, after["line"], rough, base)[0]
            after = stats.at(new, fam, extra=extra)
            value = after["dev"] + rough(new)
        moved = math.inf if beta is None else np.abs(new - beta).max() / (1e-8 + np.abs(new).max())
        drift = math.inf if rho is None else np.abs(new_rho - rho).max(initial=0)
        beta, rho, s = new, new_rho, after
        # Shape parameters follow from sums of the same job; the next step's weights are theirs.
        shaped = fam
        if extra is not None:
            shaped = _shape_moved(fam, s["extra"])
        elif profile_shape and isinstance(fam, Tweedie) and stats.profile_p:
            shaped = _power_moved(stats, fam, beta)
        still, fam = shaped is fam, shaped
        if still and (moved < 1e-7 and (drift < 1e-5 or abs(old - value) < opt.tol * (abs(value) + 0.1)) or abs(old - value) < 1e-11 * (abs(value) + 0.1)):
            break
        old = value if still else math.inf
    if profile_shape:
        sums, s = stats.likelihood(fam), s if still else stats.at(beta, fam)
    score, phi = laplace(fam, pen, rho, beta, s, sums, s["g"])
    simple = not isinstance(fam, (StudentT, Quantile))
    if fixed is None and opt.exact and method == "REML" and algorithm == "newton" and simple and len(rho):
        search = ExactScore(stats, fam, pen, sums, opt, beta)
        work = Working(s["g"], s["r"], s["zz"], s["n"])
        e, v = np.linalg.eigh(work.reml_curvature(pen, rho, phi))
        first = (v / np.maximum(np.abs(e), 0.05)) @ v.T
        rho, score = linalg.bfgs(search.score, rho, search.slope, tol=1e-7, most=50, first=first)
        rho = np.clip(rho, select.RHO_MIN, select.RHO_MAX)
        search.score(rho)
        beta, s, score, phi = search.beta, search.s, search.value, search.phi
    return beta, rho, s, fam, score, phi, it


class ExactScore:
    """The Laplace score as a function of log lambda, and its slope. Coefficients are implicit in log lambda,
    d beta / d rho_j = -H^-1 lambda_j S_j beta for the penalised observed curvature H; log |H| follows it directly, by S_j, and through
    the rows' curvatures, by leverage times their slope in eta, one sum of p numbers. No iteration is run for a difference, and each
    new point begins at the coefficients that the slope foretells."""

    def __init__(self, stats: Statistics, fam: Family, pen: Penalties, sums: np.ndarray, opt: Options, beta: np.ndarray):
        self.stats, self.fam, self.pen, self.sums, self.opt, self.beta = stats, fam, pen, sums, opt, beta
        self.rho = self.moves = None

    def score(self, rho: np.ndarray) -> float:
        rho = np.clip(rho, select.RHO_MIN, select.RHO_MAX)
        if self.rho is None or not np.array_equal(rho, self.rho):
            begin = self.beta if self.moves is None else self.beta + (rho - self.rho) @ self.moves
            if self.moves is not None and not np.abs(begin - self.beta).max() < 1 + np.abs(self.beta).max():
                begin = self.beta  # foretold too far
            self.rho, self.moves = rho, None
            self.beta, self.s, _ = pirls(self.stats, self.fam, np.exp(rho), begin, self.opt)
            self.curvature = self.stats.at(self.beta, self.fam, newton=True)["g"]
            self.value, self.phi = laplace(self.fam, self.pen, rho, self.beta, self.s, self.sums, self.curvature)
        return self.value

    def slope(self, rho: np.ndarray) -> np.ndarray:
        self.score(rho)
        lam = np.exp(self.rho)
        inverse = linalg.inverse(select.ridged(self.curvature) + self.pen.total(lam))
        through = self.stats.leverage_slope(self.beta, self.fam, inverse)
        self.moves = np.zeros((len(lam), len(self.beta)))
        trace = np.zeros(len(lam))
        for j, ((at, s), v) in enumerate(zip(self.pen.blocks, lam)):
            self.moves[j] = -inverse[:, at] @ (v * s @ self.beta[at])
            trace[j] = v * np.sum(inverse[at, at] * s)
        return lam * self.pen.quadratic(self.beta) / (2 * self.phi) + 0.5 * (trace + self.moves @ through) - 0.5 * np.array(self.pen.ranks)


def _first(stats, fam, p: Profile) -> np.ndarray:
    """A starting vector for families without starting values of their own: the response's mean, or its quantile for quantiles."""
    beta = np.zeros(stats.design.p)
    if isinstance(fam, Quantile):
        values = [p.y["mean"]]
        if hasattr(stats.rows, "columns"):
            values = np.sort(np.asarray(stats.rows.columns[TARGET], np.float64))
            beta[0] = values[int(round((len(values) - 1) * fam.tau))]
        else:
            ends = lambda n: [math.floor((n - 1) * fam.tau), math.ceil((n - 1) * fam.tau)]
            beta[0] = np.mean(order_statistics(stats.rows.df, F.col(TARGET), ends))
    elif isinstance(fam, StudentT):
        beta[0] = p.y["mean"]
    return beta


def _vertex(grid: np.ndarray, e: np.ndarray) -> float:
    """The best of an even grid, refined by the parabola through it and its neighbours."""
    j = int(np.argmax(e))
    if not 0 < j < len(grid) - 1:
        return float(grid[j])
    a, b, c = e[j - 1], e[j], e[j + 1]
    shift = 0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c < 0 else 0.0
    return float(grid[j] + shift * (grid[1] - grid[0]))


def _shape_sums(fam: Family):
    """Sums of (y, eta, w) that a family's shape parameters follow from, for the same job as all else; None if it has none."""
    if isinstance(fam, StudentT):
        return fam.shape_sums
    if isinstance(fam, NegBin):
        fams = [replace(fam, theta=float(v)) for v in THETAS]

        def like(y, eta, w):
            mu, (u, at) = fam.link.inverse(NP, eta), np.unique(y, return_inverse=True)
            each = np.bincount(at, weights=w)  # counts repeat: the likelihood needs each once
            return np.array([f.likelihood_sums(u, each)[0] - 0.5 * (w * f.deviance(NP, y, mu)).sum() for f in fams])

        return like
    if isinstance(fam, OrderedCategorical) and fam.theta:
        probes = _probes(fam)
        return lambda y, eta, w: np.array([(w * f.deviance(NP, y, eta)).sum() for f in probes])
    return None


#: Shapes of the negative binomial that are scored side by side, and the distance of thresholds that slopes are taken over.
THETAS, PROBE = np.exp(np.linspace(math.log(0.5), math.log(50.0), 16)), 1e-3


def _probes(fam: OrderedCategorical) -> list[OrderedCategorical]:
    theta = np.array(fam.theta)
    return [replace(fam, theta=tuple(theta + PROBE * i * e)) for e in np.eye(len(theta)) for i in (-1, 0, 1)]


def _shape_moved(fam: Family, e: np.ndarray) -> Family:
    """The family with its shape parameters moved by the sums of _shape_sums(); itself where they stay."""
    if isinstance(fam, StudentT):
        return fam.shape_step(e)
    if isinstance(fam, NegBin):
        theta = math.exp(_vertex(np.log(THETAS), e))
        return fam if abs(math.log(theta / fam.theta)) < 1e-4 else replace(fam, theta=theta)
    theta, e = np.array(fam.theta), e.reshape(-1, 3)
    g, h = (e[:, 2] - e[:, 0]) / (2 * PROBE), (e[:, 2] - 2 * e[:, 1] + e[:, 0]) / PROBE**2
    move = np.clip(-g / np.maximum(np.abs(h), 1e-6), -0.5, 0.5)
    return fam if np.abs(move).max() < 1e-5 else replace(fam, theta=tuple((theta + move).tolist()))


def _power_moved(stats, fam: Tweedie, beta: np.ndarray) -> Family:
    """The Tweedie power of the best likelihood at the current fit: a grid in one job, and a finer one between its best neighbours."""

    def score(grid):
        def like(y, eta, w):
            mu = fam.link.inverse(NP, eta)
            out = []
            for q in grid:
                f = replace(fam, p=float(q))
                phi = max(float((w * (y - mu) ** 2 / f.variance(NP, mu)).sum() / max(len(y), 1)), 1e-8)
                out.append(f.log_density_at_y(y, phi).sum() - 0.5 * (w * f.deviance(NP, y, mu)).sum() / phi)
            return np.array(out)

        return stats.at(beta, fam, extra=like)["extra"]

    grid = np.concatenate([[1.001], np.linspace(1.05, 1.95, 19), [1.999]])
    j = int(np.argmax(score(grid)))
    fine = np.linspace(grid[max(j - 1, 0)], grid[min(j + 1, len(grid) - 1)], 21)
    q = _vertex(fine, score(fine))
    return fam if abs(q - fam.p) < 1e-5 else replace(fam, p=q)


def reml_at(model: GamModel, lam) -> float:
    """The Gaussian working score of a fitted model at any smoothing parameters, from its stored sums."""
    d = Design(model.terms)
    return Working(model.gram, model.rhs, model.zz, model.rows).reml(d.penalties, np.log(np.asarray(lam, np.float64)), None if not model.fam.known_scale else 1.0)


def reml_derivatives(model: GamModel, lam) -> tuple[np.ndarray, np.ndarray]:
    d, rho = Design(model.terms), np.log(np.asarray(lam, np.float64))
    w, phi = Working(model.gram, model.rhs, model.zz, model.rows), None if not model.fam.known_scale else 1.0
    return w.reml_slope(d.penalties, rho, phi), w.reml_curvature(d.penalties, rho, phi)
