"""Choosing smoothing parameters from additive statistics, without further passes over rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from ..functions.families import LOG2PI
from . import linalg


@dataclass
class Penalties:
    """Blocks (slice, S) of a design of p columns."""

    p: int
    blocks: list[tuple[slice, np.ndarray]]

    def __post_init__(self):
        self.ranks, self.logdets = zip(*(linalg.rank_and_logdet(s) for _, s in self.blocks)) if self.blocks else ((), ())
        self.null = self.p - sum(self.ranks)

    def total(self, lam: np.ndarray) -> np.ndarray:
        out = np.zeros((self.p, self.p))
        for (at, s), v in zip(self.blocks, lam):
            out[at, at] += v * s
        return out

    def logdet(self, lam: np.ndarray) -> float:
        return sum(r * math.log(v) + d for r, v, d in zip(self.ranks, lam, self.logdets))

    def quadratic(self, beta: np.ndarray) -> np.ndarray:
        """beta' S_j beta for each block."""
        return np.array([beta[at] @ s @ beta[at] for at, s in self.blocks])


def ridged(g: np.ndarray) -> np.ndarray:
    return g + 1e-12 * np.diag(np.maximum(np.diag(g), 1e-300))


@dataclass
class Working:
    """A weighted least-squares problem by its sums: G = X'WX, r = X'Wz, zz = z'Wz, n rows."""

    g: np.ndarray
    r: np.ndarray
    zz: float
    n: float

    def beta(self, pen: Penalties, lam: np.ndarray) -> np.ndarray:
        return linalg.solve(ridged(self.g) + pen.total(lam), self.r)

    def inverse(self, pen: Penalties, lam: np.ndarray) -> np.ndarray:
        """Of the penalised system's matrix."""
        return linalg.inverse(ridged(self.g) + pen.total(lam))

    def _solved(self, inverse: np.ndarray, pen: Penalties, lam: np.ndarray) -> np.ndarray:
        return inverse @ self.r

    def logdet(self, pen: Penalties, lam: np.ndarray) -> float:
        return linalg.logdet(ridged(self.g) + pen.total(lam))

    def rss(self, beta: np.ndarray) -> float:
        return max(self.zz - 2 * beta @ self.r + beta @ self.g @ beta, 0.0)

    def edf(self, pen: Penalties, lam: np.ndarray) -> np.ndarray:
        return np.diag(linalg.solve(ridged(self.g) + pen.total(lam), self.g))

    def reml(self, pen: Penalties, rho: np.ndarray, phi: float | None = None, log_weights: float = 0.0) -> float:
        """Restricted likelihood score at log lambda, to be minimised; phi None: the best one."""
        lam = np.exp(rho)
        beta = self.beta(pen, lam)
        pdev = self.rss(beta) + lam @ pen.quadratic(beta)
        scale = phi if phi is not None else max(pdev / (self.n - pen.null), 1e-300)
        half = 0.5 * (self.logdet(pen, lam) - pen.logdet(lam))
        return pdev / (2 * scale) + (self.n - pen.null) / 2 * (LOG2PI + math.log(scale)) + half - 0.5 * log_weights

    def reml_slope(self, pen: Penalties, rho: np.ndarray, phi: float | None = None) -> np.ndarray:
        lam = np.exp(rho)
        beta = self.beta(pen, lam)
        quad = pen.quadratic(beta)
        scale = phi if phi is not None else max((self.rss(beta) + lam @ quad) / (self.n - pen.null), 1e-300)
        inv = self.inverse(pen, lam)
        trace = np.array([np.sum(inv[at, at] * s) for at, s in pen.blocks])
        return lam * quad / (2 * scale) + 0.5 * lam * trace - 0.5 * np.array(pen.ranks)

    def joint(self, pen: Penalties, rho: np.ndarray, log_phi: float) -> tuple[float, np.ndarray, np.ndarray]:
        """The restricted likelihood score at (log lambda, log scale), its slope and its curvature, from one factorisation of the
        penalised system. Coefficients follow log lambda: d beta / d rho_j = -A^-1 lambda_j S_j beta."""
        lam, m, phi = np.exp(rho), len(rho), math.exp(log_phi)
        inv = self.inverse(pen, lam)
        beta = self._solved(inv, pen, lam)
        own = np.zeros((m, self.g.shape[0]))  # lambda_j S_j beta
        spread = []  # A^-1 lambda_j S_j, where it isn't 0
        for j, ((at, s), v) in enumerate(zip(pen.blocks, lam)):
            own[j, at] = v * (s @ beta[at])
            spread.append(v * inv[:, at] @ s)
        rough = own @ beta
        trace = np.array([np.trace(x[at]) for x, (at, _) in zip(spread, pen.blocks)])
        pdev = self.rss(beta) + rough.sum()
        free = self.n - pen.null
        score = pdev / (2 * phi) + free / 2 * (LOG2PI + log_phi) + 0.5 * (self.logdet(pen, lam) - pen.logdet(lam))
        slope = np.append(rough / (2 * phi) + 0.5 * trace - 0.5 * np.array(pen.ranks), free / 2 - pdev / (2 * phi))
        curve = np.zeros((m + 1, m + 1))
        curve[:m, :m] = np.diag(rough / (2 * phi) + 0.5 * trace) - own @ inv @ own.T / phi
        for i, (at_i, _) in enumerate(pen.blocks):
            for j, (at_j, _) in enumerate(pen.blocks[: i + 1]):
                both = 0.5 * np.sum(spread[i][at_j] * spread[j][at_i].T)
                curve[i, j] -= both
                curve[j, i] -= both if i != j else 0.0
        curve[:m, m] = curve[m, :m] = -rough / (2 * phi)
        curve[m, m] = pdev / (2 * phi)
        return score, slope, curve

    def best_log_phi(self, pen: Penalties, rho: np.ndarray) -> float:
        lam = np.exp(rho)
        beta = self.beta(pen, lam)
        return math.log(max((self.rss(beta) + lam @ pen.quadratic(beta)) / (self.n - pen.null), 1e-300))

    def freml_step(self, pen: Penalties, rho: np.ndarray, log_phi: float | None) -> tuple[np.ndarray, float | None]:
        """One Newton step of the score in log lambda and log scale together (log_phi None: a scale of 1, and no step in it). Curvature
        counts by size, and a step that raises the score is halved; no rows are needed for either."""
        known, m = log_phi is None, len(rho)
        x = rho if known else np.append(rho, log_phi)
        at = lambda v: self.joint(pen, v[:m], 0.0 if known else v[m])
        f, g, h = at(x)
        g, h = (g[:m], h[:m, :m]) if known else (g, h)
        live = (np.abs(g) > 1e-9 * (abs(f) + 1)) | (np.abs(np.diag(h)) > 1e-8)
        move = np.zeros(len(x))
        if live.any():
            move[live] = downhill(g[live], h[np.ix_(live, live)])
        for a in 0.5 ** np.arange(20):
            new = x + a * move
            new[:m] = np.clip(new[:m], RHO_MIN, RHO_MAX)
            if np.isfinite(fn := at(new)[0]) and fn <= f + 1e-12 * (abs(f) + 1):
                return new[:m], None if known else float(new[m])
        return rho, log_phi

    def reml_curvature(self, pen: Penalties, rho: np.ndarray, phi: float | None = None) -> np.ndarray:
        """Second derivatives of reml(): with the scale given, or following log lambda at its best."""
        m = len(rho)
        h = self.joint(pen, rho, math.log(phi) if phi is not None else self.best_log_phi(pen, rho))[2]
        return h[:m, :m] if phi is not None else h[:m, :m] - np.outer(h[:m, m], h[m, :m]) / max(h[m, m], 1e-300)

    def gcv(self, pen: Penalties, rho: np.ndarray) -> float:
        lam = np.exp(rho)
        return self.n * self.rss(self.beta(pen, lam)) / max(self.n - self.edf(pen, lam).sum(), 1e-8) ** 2

    def fellner_schall(self, pen: Penalties, lam: np.ndarray, phi: float) -> np.ndarray:
        """One multiplicative update, by at most e^3, within [1e-9, 1e7]."""
        inv = self.inverse(pen, lam)
        beta = self._solved(inv, pen, lam)
        trace = np.array([np.sum(inv[at, at] * s) for at, s in pen.blocks])
        gain = np.maximum(np.array(pen.ranks) / lam - trace, 1e-12) * phi / np.maximum(pen.quadratic(beta), 1e-12)
        return np.clip(lam * np.exp(np.clip(np.log(gain * 1.0), -3, 3)), 1e-9, 1e7)


class Triangular(Working):
    """The same from the triangular factor R of [sqrt W X, sqrt W z], for columns so much alike that X'WX has lost their difference:
    errors grow with the condition of X, not its square. Penalties are stacked below as roots, and no ridge is added."""

    def __init__(self, factor: np.ndarray, n: float):
        p = len(factor) - 1
        self.x, self.z, self.left = factor[:p, :p], factor[:p, p], float(factor[p, p] ** 2)
        super().__init__(self.x.T @ self.x, self.x.T @ self.z, float(self.z @ self.z) + self.left, n)

    def _stacked(self, pen: Penalties, lam: np.ndarray) -> np.ndarray:
        blocks = [self.x]
        for (at, s), v in zip(pen.blocks, lam):
            below = np.zeros((len(s), pen.p))
            below[:, at] = np.sqrt(v) * linalg.root(s).T
            blocks.append(below)
        return np.vstack(blocks)

    def _pseudo_inverse(self, pen: Penalties, lam: np.ndarray) -> np.ndarray:
        a = self._stacked(pen, lam)
        scale = np.maximum(np.linalg.norm(a, axis=0), 1e-300)
        return np.linalg.pinv(a / scale, rcond=len(a) * np.finfo(float).eps) / scale[:, None]

    def beta(self, pen: Penalties, lam: np.ndarray) -> np.ndarray:
        a = self._stacked(pen, lam)
        scale = np.maximum(np.linalg.norm(a, axis=0), 1e-300)
        return np.linalg.lstsq(a / scale, np.concatenate([self.z, np.zeros(len(a) - len(self.z))]), rcond=len(a) * np.finfo(float).eps)[0] / scale

    def inverse(self, pen: Penalties, lam: np.ndarray) -> np.ndarray:
        a = self._pseudo_inverse(pen, lam)
        return a @ a.T

    def _solved(self, inverse: np.ndarray, pen: Penalties, lam: np.ndarray) -> np.ndarray:
        return self.beta(pen, lam)

    def logdet(self, pen: Penalties, lam: np.ndarray) -> float:
        return float(2 * np.log(np.maximum(np.abs(np.diag(np.linalg.qr(self._stacked(pen, lam), mode="r"))), 1e-150)).sum())

    def edf(self, pen: Penalties, lam: np.ndarray) -> np.ndarray:
        return np.diag(self._pseudo_inverse(pen, lam)[:, : len(self.x)] @ self.x)

    def rss(self, beta: np.ndarray) -> float:
        off = self.x @ beta - self.z
        return float(off @ off) + self.left


def working(s: dict) -> Working:
    """The least-squares problem in the statistics of a step: by its factor, if they have one."""
    return Triangular(s["factor"], s["n"]) if s.get("factor") is not None else Working(s["g"], s["r"], s["zz"], s["n"])


RHO_MIN, RHO_MAX = math.log(1e-9), math.log(1e7) + 6


def downhill(g: np.ndarray, h: np.ndarray, cap: float = 5.0) -> np.ndarray:
    """A Newton step of at most `cap`, with eigenvalues by size and kept off 0."""
    e, v = np.linalg.eigh(h)
    e = np.maximum(np.abs(e), max(np.abs(e).max(initial=0), 1e-300) * np.finfo(float).eps ** 0.7)
    move = -(v / e) @ (v.T @ g)
    return move * min(1.0, cap / max(np.linalg.norm(move), 1e-300))


def newton(score, slope, curvature, rho: np.ndarray, tol: float = 5e-7, most: int = 200) -> np.ndarray:
    """Newton's method on log lambda: eigenvalues taken by size and kept off 0, steps of at most 5, halved until the score falls;
    parameters whose slope and curvature have both run out stay where they are."""
    f = score(rho)
    for _ in range(most):
        g, h = slope(rho), curvature(rho)
        if np.abs(g).max(initial=0) < tol * (abs(f) + 1):
            break
        live = (np.abs(g) > 0.1 * tol * (abs(f) + 1)) | (np.abs(np.diag(h)) > 1e-8)
        move = np.zeros(len(rho))
        move[live] = downhill(g[live], h[np.ix_(live, live)])
        if not np.isfinite(move).all():  # nothing is left over of the response, and the scale has run out
            break
        a, better = 1.0, False
        while a > 1e-6:
            new = np.clip(rho + a * move, RHO_MIN, RHO_MAX)
            fn = score(new)
            if np.isfinite(fn) and fn < f:
                better = True
                break
            a /= 2
        if not better:
            break
        small = abs(f - fn) < 1e-12 * (abs(f) + 1)
        rho, f = new, fn
        if small:
            break
    return rho


def start(w: Working, pen: Penalties) -> np.ndarray:
    """Log lambdas that put a penalty on a par with its block of the Gram matrix."""
    return np.array([math.log(max(np.trace(w.g[at, at]), 1e-8) / max(np.trace(s), 1e-8)) for at, s in pen.blocks])


def choose(w: Working, pen: Penalties, method: str = "REML", algorithm: str = "newton", rho: np.ndarray | None = None, phi: float | None = None) -> np.ndarray:
    """Log lambda for a fixed working problem."""
    rho = start(w, pen) if rho is None else rho
    if not len(rho):
        return rho
    if method.upper() == "GCV":
        best = min((np.clip(rho + d, RHO_MIN, RHO_MAX) for d in (-6, -3, 0, 3, 6)), key=lambda x: w.gcv(pen, x))
        return linalg.bfgs(lambda x: math.log(w.gcv(pen, np.clip(x, RHO_MIN, RHO_MAX)) + 1e-300), best)[0].clip(RHO_MIN, RHO_MAX)
    if method.upper() == "FREML" and algorithm == "newton":
        log_phi = w.best_log_phi(pen, rho) if phi is None else None
        for _ in range(200):
            new, log_phi = w.freml_step(pen, rho, log_phi)
            done = np.abs(new - rho).max() < 1e-7
            rho = new
            if done:
                break
        return rho
    if algorithm == "fellner-schall":
        lam = np.exp(rho)
        for _ in range(200):
            beta = w.beta(pen, lam)
            scale = phi if phi is not None else max((w.rss(beta) + lam @ pen.quadratic(beta)) / (w.n - pen.null), 1e-300)
            new = w.fellner_schall(pen, lam, scale)
            done = np.abs(np.log(new / lam)).max() < 1e-6
            lam = new
            if done:
                break
        return np.log(lam)
    return newton(lambda x: w.reml(pen, x, phi), lambda x: w.reml_slope(pen, x, phi), lambda x: w.reml_curvature(pen, x, phi), rho)


def grid(w: Working, pen: Penalties, lo: float = -4, hi: float = 6, steps: int = 41, score: str = "gcv") -> float:
    """The common lambda on a log grid with the least score."""
    values = 10 ** np.linspace(lo, hi, steps)
    f = (lambda r: w.gcv(pen, r)) if score == "gcv" else (lambda r: w.reml(pen, r))
    return float(min(values, key=lambda v: f(np.full(len(pen.blocks), math.log(v)))))
