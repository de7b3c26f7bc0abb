"""Smooth, random-effect and linear terms: bases as numpy kernels and as Spark columns, penalties and constraints."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Term:
    """One column's term. After prepare(), basis(x) @ z is its block of the design, and s the penalty of that block."""

    name: str
    k: int = 10
    pc: float | None = None
    z: np.ndarray | None = None
    s: np.ndarray | None = None
    kind = "?"
    penalised = True
    centred = True

    @property
    def size(self) -> int:
        return self.z.shape[1]

    def basis(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def penalty(self) -> np.ndarray:
        raise NotImplementedError

    def prepare(self, column_sums: np.ndarray, n: float, row_norm: float) -> None:
        """Scales the raw penalty to the raw basis by their infinity norms, and then takes the constraint out."""
        s = self.penalty()
        norm = np.abs(s).sum(1).max(initial=0)
        if norm > 0:
            s = s * (row_norm**2 / norm)
        if self.pc is not None and self.centred:
            self.z = null_basis(self.basis(np.array([float(self.pc)]))[0])
        elif self.centred:
            self.z = sum_to_zero(column_sums / n)
        else:
            self.z = np.eye(len(s))
        self.s = self.z.T @ s @ self.z

    def block(self, x: np.ndarray) -> np.ndarray:
        return self.basis(x) @ self.z

    def breaks(self) -> np.ndarray:
        raise NotImplementedError

    def column(self, x: Column, beta: np.ndarray) -> Column:
        """The term as a piecewise polynomial of x: one CASE over the knot intervals, linear beyond them."""
        g = self.z @ beta
        cuts = self.breaks()
        u = np.array([0.0, 1 / 3, 2 / 3, 1.0])
        to_poly = np.linalg.inv(np.vander(u, 4, increasing=True))
        lo, hi = float(cuts[0]), float(cuts[-1])
        span = max(hi - lo, 1e-300)
        f = lambda v: (self.basis(np.atleast_1d(np.asarray(v, np.float64))) @ g)
        out_lo, out_hi = f([lo - span, lo]), f([hi, hi + span])
        case = F.when(x < lo, F.lit(float(out_lo[1])) + (x - lo) * F.lit(float((out_lo[1] - out_lo[0]) / span)))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            c = to_poly @ f(a + u * (b - a))
            t = (x - F.lit(a)) / F.lit(b - a)
            case = case.when(x <= b, F.lit(float(c[0])) + t * (F.lit(float(c[1])) + t * (F.lit(float(c[2])) + t * F.lit(float(c[3])))))
        return case.when(x > hi, F.lit(float(out_hi[0])) + (x - hi) * F.lit(float((out_hi[1] - out_hi[0]) / span)))

    def state(self) -> dict:
        out = {"kind": self.kind}
        for k, v in self.__dict__.items():
            out[k] = {"array": v.tolist()} if isinstance(v, np.ndarray) else v
        return out


def sum_to_zero(means: np.ndarray) -> np.ndarray:
    """Columns orthogonal to the column means: a Householder reflection without its first column."""
    v = means.copy()
    v[0] += np.copysign(np.linalg.norm(means), means[0] if means[0] else 1.0)
    return (np.eye(len(v)) - 2 * np.outer(v, v) / max(v @ v, 1e-300))[:, 1:]


def null_basis(row: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the vectors that row is orthogonal to."""
    return np.linalg.svd(row[None, :], full_matrices=True)[2][1:].T


@dataclass
class Cubic(Term):
    """Cardinal natural cubic spline on knots, linear beyond the first and last."""

    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    kind = "cr"

    def _curvature(self) -> tuple[np.ndarray, np.ndarray]:
        """F, which takes values at the knots to second derivatives there, and the penalty."""
        h, k = np.diff(self.knots), len(self.knots)
        d, b = np.zeros((k - 2, k)), np.zeros((k - 2, k - 2))
        for i in range(k - 2):
            d[i, i : i + 3] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
            b[i, i] = (h[i] + h[i + 1]) / 3
            if i:
                b[i, i - 1] = b[i - 1, i] = h[i] / 6
        inner = np.linalg.solve(b, d) if k > 2 else d
        return np.vstack([np.zeros((1, k)), inner, np.zeros((1, k))]), d.T @ inner

    def penalty(self):
        s = self._curvature()[1]
        return (s + s.T) / 2

    def breaks(self):
        return self.knots

    def basis(self, x):
        t, k = self.knots, len(self.knots)
        f = self._curvature()[0]
        j = np.clip(np.searchsorted(t, x, "right") - 1, 0, k - 2)
        h = np.diff(t)[j]
        inside = np.clip(x, t[0], t[-1])
        a, b = (t[j + 1] - inside) / h, (inside - t[j]) / h
        rows = np.arange(len(x))
        out = ((a**3 - a) * h * h / 6)[:, None] * f[j] + ((b**3 - b) * h * h / 6)[:, None] * f[j + 1]
        out[rows, j] += a
        out[rows, j + 1] += b
        beyond = x - inside
        if np.any(beyond):  # with the slope at the end
            slope = ((1 - 3 * a**2) * h / 6)[:, None] * f[j] + ((3 * b**2 - 1) * h / 6)[:, None] * f[j + 1]
            slope[rows, j] -= 1 / h
            slope[rows, j + 1] += 1 / h
            out += beyond[:, None] * slope
        return out


@dataclass
class BSpline(Term):
    """Cubic B-splines on even knots, the curvature integral as penalty, and a tangent beyond the outer knots."""

    lo: float = 0.0
    hi: float = 1.0
    kind = "bs"

    @property
    def all_knots(self) -> np.ndarray:
        margin = 0.001 * (self.hi - self.lo)
        a, b, inner = self.lo - margin, self.hi + margin, self.k - 2
        h = (b - a) / (inner - 1)
        return a + h * np.arange(-3, inner + 3)

    def breaks(self):
        return self.all_knots[3:-3]

    def derivative(self, x, d: int = 0) -> np.ndarray:
        t = self.all_knots
        h = t[1] - t[0]
        j = np.clip(np.floor((x - t[0]) / h).astype(int), 3, len(t) - 5)
        u = (x - t[j]) / h
        one = np.ones_like(u)
        four = {
            0: ((1 - u) ** 3, 3 * u**3 - 6 * u**2 + 4, -3 * u**3 + 3 * u**2 + 3 * u + 1, u**3),
            1: (-3 * (1 - u) ** 2, 9 * u**2 - 12 * u, -9 * u**2 + 6 * u + 3, 3 * u**2),
            2: (6 * (1 - u), 18 * u - 12, -18 * u + 6, 6 * u),
            3: (-6 * one, 18 * one, -18 * one, 6 * one),
        }[d]
        out = np.zeros((len(x), len(t) - 4))
        for i, v in enumerate(four):
            out[np.arange(len(x)), j - 3 + i] = v / 6 / h**d
        return out

    def basis(self, x):
        cut = self.breaks()
        inside = np.clip(x, cut[0], cut[-1])
        out = self.derivative(inside)
        beyond = x - inside
        if np.any(beyond):
            out = out + beyond[:, None] * self.derivative(inside, 1)
        return out

    def penalty(self):
        cut = self.breaks()
        g, w = np.polynomial.legendre.leggauss(5)
        mid, half = (cut[1:] + cut[:-1]) / 2, np.diff(cut) / 2
        b = self.derivative((mid[:, None] + half[:, None] * g[None, :]).ravel(), 2)
        return b.T @ (b * (half[:, None] * w[None, :]).ravel()[:, None])


@dataclass
class ThinPlate(Term):
    """One-dimensional thin plates: 1, x and cubed distances to knots, which alone are penalised."""

    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    kind = "tps"

    def basis(self, x):
        return np.concatenate([np.ones((len(x), 1)), x[:, None], np.abs(x[:, None] - self.knots[None, :]) ** 3], axis=1)

    def penalty(self):
        return np.diag(np.concatenate([[0.0, 0.0], np.ones(len(self.knots))]))

    def column(self, x, beta):
        g = self.z @ beta
        out = F.lit(float(g[0])) + F.lit(float(g[1])) * x
        for c, t in zip(g[2:].tolist(), self.knots.tolist()):
            out = out + F.lit(c) * F.pow(F.abs(x - F.lit(t)), 3)
        return out


@dataclass
class RandomEffect(Term):
    """One coefficient for each level of a column of any type, shrunk to 0; an unseen level counts 0."""

    levels: list = field(default_factory=list)
    kind = "re"
    centred = False

    def basis(self, x):
        at = pd.Index(self.levels).get_indexer(pd.Index(x)) if len(self.levels) else np.full(len(x), -1)
        out, known = np.zeros((len(x), len(self.levels))), np.flatnonzero(at >= 0)
        out[known, at[known]] = 1.0
        return out

    def penalty(self):
        return np.eye(len(self.levels))

    def prepare(self, column_sums, n, row_norm):
        self.z, self.s = np.eye(len(self.levels)), np.eye(len(self.levels))

    def column(self, x, beta):
        pairs = [v for lv, b in zip(self.levels, beta.tolist()) for v in (F.lit(lv), F.lit(float(b)))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), x), F.lit(0.0)) if pairs else F.lit(0.0)


@dataclass
class Linear(Term):
    """The column itself, not penalised and not centred."""

    kind = "parametric"
    penalised = False
    centred = False

    def basis(self, x):
        return np.asarray(x, np.float64)[:, None]

    def penalty(self):
        return np.zeros((1, 1))

    def prepare(self, column_sums, n, row_norm):
        self.z, self.s = np.eye(1), np.zeros((1, 1))

    def column(self, x, beta):
        return x * F.lit(float(beta[0]))


KINDS = {c.kind: c for c in (Cubic, BSpline, ThinPlate, RandomEffect, Linear)}
#: The least k that a basis can have.
LEAST_K = {"cr": 3, "bs": 4, "tps": 3}


def quantile_knots(values: np.ndarray, k: int) -> np.ndarray:
    """Knots at the quantiles i / (k - 1) of the distinct values, evenly spaced if there are fewer of them than k."""
    u = np.unique(values)
    return np.quantile(u, np.linspace(0, 1, k)) if len(u) >= k else np.linspace(u[0], u[-1] if u[-1] > u[0] else u[0] + 1, k)


def restored(state: dict) -> Term:
    """The term of a state() that went through JSON."""
    state = dict(state)
    made = KINDS[state.pop("kind")](state.pop("name"))
    for k, v in state.items():
        setattr(made, k, np.array(v["array"]) if isinstance(v, dict) and "array" in v else v)
    return made


def dumps(terms: list[Term]) -> str:
    return json.dumps([t.state() for t in terms], default=str)
