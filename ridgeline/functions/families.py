"""Response distributions: variance, deviance, working pair and saturated likelihood, for numpy arrays and Spark columns.

`working` gives (w, g): a non-negative curvature and the score in eta, so that a penalised step solves X'WX + S against
X'(w eta + g) for every family alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np

from .links import ETA_MAX, LINKS, Link
from .ops import NP, safe
from .special import digamma, lgamma, sigmoid, sigmoid_slope, softplus, trigamma

LOG2PI = math.log(2 * math.pi)


@dataclass(frozen=True)
class Family:
    name: str = "gaussian"
    link_name: str = "identity"
    links = ("identity",)
    known_scale = False
    positive = False

    @property
    def link(self) -> Link:
        return LINKS[self.link_name]

    def with_params(self, **kw):
        return replace(self, **kw)

    def params(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("name", "link_name")}

    def variance(self, o, mu):
        return mu * 0.0 + 1.0

    def variance_slopes(self, o, mu):
        """V', V'' and V'''."""
        return mu * 0.0, mu * 0.0, mu * 0.0

    def deviance(self, o, y, mu):
        return (y - mu) * (y - mu)

    def start(self, o, y):
        return y

    def mean(self, o, eta):
        return self.link.inverse(o, eta)

    def working(self, o, y, eta, newton=False):
        """Curvature and score; with newton, the observed curvature where it is positive and the expected one elsewhere."""
        mu = self.link.safe_mu(o, self.link.inverse(o, eta))
        slope, v = self.link.slope(o, eta), self.variance(o, mu)
        w = slope * slope / v
        if newton:
            alpha = 1.0 + (y - mu) * (self.variance_slopes(o, mu)[0] / v + self.link.derivatives(o, mu)[0] * slope)
            w = o.where(alpha > 0, w * alpha, w)
        return o.greatest(w, 1e-10), (y - mu) * slope / v

    def observed(self, o, y, eta):
        """The observed curvature, which may fall below 0."""
        mu = self.link.safe_mu(o, self.link.inverse(o, eta))
        slope, v = self.link.slope(o, eta), self.variance(o, mu)
        alpha = 1.0 + (y - mu) * (self.variance_slopes(o, mu)[0] / v + self.link.derivatives(o, mu)[0] * slope)
        return slope * slope / v * alpha

    def curvature_slope(self, o, y, eta):
        """d/d eta of the observed curvature. With a = 1 + (y - mu) (V'/V + g''/g'), the curvature is a / (g'^2 V)."""
        mu = self.link.safe_mu(o, self.link.inverse(o, eta))
        slope, v, (v1, v2, _), (g2, g3, _) = self.link.slope(o, eta), self.variance(o, mu), self.variance_slopes(o, mu), self.link.derivatives(o, mu)
        r1, g21, g31 = v1 / v, g2 * slope, g3 * slope
        a = 1.0 + (y - mu) * (r1 + g21)
        a1 = -(r1 + g21) + (y - mu) * (v2 / v - r1 * r1 + g31 - g21 * g21)
        return slope * slope * slope / v * (a1 - a * (r1 + 2.0 * g21))

    def deviance_eta(self, o, y, eta):
        return self.deviance(o, y, self.link.safe_mu(o, self.link.inverse(o, eta)))

    def likelihood_sums(self, y, w) -> np.ndarray:
        """Sums over rows that saturated() needs beside n: by default the sum of log weights."""
        return np.array([np.log(w[w > 0]).sum()])

    def saturated(self, phi: float, n: float, sums: np.ndarray) -> float:
        """Saturated log likelihood."""
        return -0.5 * n * (LOG2PI + math.log(phi)) + 0.5 * sums[0]

    def scale(self, pdev: float, n: float, null: float, sums: np.ndarray) -> float:
        """The scale that maximises the restricted likelihood, given the penalised deviance and the null space's dimension."""
        return 1.0 if self.known_scale else max(pdev / max(n - null, 1e-8), 1e-300)


@dataclass(frozen=True)
class Gaussian(Family):
    pass


@dataclass(frozen=True)
class Binomial(Family):
    name: str = "binomial"
    link_name: str = "logit"
    links = ("logit",)
    known_scale = True

    def variance(self, o, mu):
        return mu * (1.0 - mu)

    def variance_slopes(self, o, mu):
        return 1.0 - 2.0 * mu, mu * 0.0 - 2.0, mu * 0.0

    def working(self, o, y, eta, newton=False):
        """Past the clamp of eta, curvature (and the score of rows told right) decays on as without it: rows that are certain would
        else hold back all steps of separable rows."""
        w, g = super().working(o, y, eta, newton)
        past = o.exp(o.least(ETA_MAX - o.abs(eta), 0.0))
        return o.greatest(w * past, 1e-10), o.where(o.abs(g) < 0.5, g * past, g)

    def deviance(self, o, y, mu):
        one = safe(o, y > 0, y, lambda v: v * o.log(v), 0.0) - y * o.log(mu)
        two = safe(o, y < 1, 1.0 - y, lambda v: v * o.log(v), 0.0) - (1.0 - y) * o.log(1.0 - mu)
        return 2.0 * (one + two)

    def start(self, o, y):
        return o.least(o.greatest(y, 0.01), 0.99)

    def likelihood_sums(self, y, w):
        t = lambda v: np.where((v > 0), v * np.log(np.where(v > 0, v, 1)), 0.0)
        return np.array([(w * (t(y) + t(1 - y))).sum()])

    def saturated(self, phi, n, sums):
        return float(sums[0])


@dataclass(frozen=True)
class QuasiBinomial(Binomial):
    name: str = "quasibinomial"
    known_scale = False

    def likelihood_sums(self, y, w):
        return Family.likelihood_sums(self, y, w)

    def saturated(self, phi, n, sums):
        return -0.5 * n * math.log(phi) + 0.5 * sums[0]


class _Positive(Family):
    positive = True

    def start(self, o, y):
        return o.greatest(y, 0.1)


@dataclass(frozen=True)
class Poisson(_Positive):
    name: str = "poisson"
    link_name: str = "log"
    links = ("log",)
    known_scale = True

    def variance(self, o, mu):
        return mu

    def variance_slopes(self, o, mu):
        return mu * 0.0 + 1.0, mu * 0.0, mu * 0.0

    def deviance(self, o, y, mu):
        return 2.0 * (safe(o, y > 0, y, lambda v: v * o.log(v / mu), 0.0) - (y - mu))

    def likelihood_sums(self, y, w):
        ylogy = np.where(y > 0, y * np.log(np.where(y > 0, y, 1)), 0.0)
        return np.array([(w * (ylogy - y - lgamma(NP, y + 1.0))).sum()])

    def saturated(self, phi, n, sums):
        return float(sums[0])


@dataclass(frozen=True)
class QuasiPoisson(Poisson):
    name: str = "quasipoisson"
    known_scale = False

    def likelihood_sums(self, y, w):
        return Family.likelihood_sums(self, y, w)

    def saturated(self, phi, n, sums):
        return -0.5 * n * math.log(phi) + 0.5 * sums[0]


@dataclass(frozen=True)
class Gamma(_Positive):
    name: str = "gamma"
    link_name: str = "inverse"
    links = ("inverse", "log")

    def variance(self, o, mu):
        return mu * mu

    def variance_slopes(self, o, mu):
        return 2.0 * mu, mu * 0.0 + 2.0, mu * 0.0

    def deviance(self, o, y, mu):
        m = o.greatest(mu, 1e-10)
        return 2.0 * ((y - m) / m - o.log(o.greatest(y, 1e-300) / m))

    def likelihood_sums(self, y, w):
        return np.array([np.log(w).sum(), w.sum(), (w * 0 + np.log(np.maximum(y, 1e-300))).sum()])

    def saturated(self, phi, n, sums):
        # Equal weights inside the gamma function: their mean stands for each.
        k = max(sums[1] / n, 1e-300) / phi
        return n * (k * math.log(k) - k - float(lgamma(NP, np.float64(k)))) - sums[2]

    def scale(self, pdev, n, null, sums):
        """Newton on log phi for -pdev / 2 phi + saturated(phi) + null / 2 log(2 pi phi)."""
        wbar, t = max(sums[1] / n, 1e-300), math.log(max(pdev / max(n - null, 1), 1e-8))
        for _ in range(100):
            phi = math.exp(t)
            k = wbar / phi
            # d/dt with k = wbar e^-t
            grad = pdev / (2 * phi) - n * k * (math.log(k) - float(digamma(k))) + null / 2
            hess = -pdev / (2 * phi) + n * k * (math.log(k) - float(digamma(k))) + n * k * (1 - k * float(trigamma(k)))
            step = -grad / hess if hess < 0 else math.copysign(0.5, grad)
            t += max(-1.0, min(1.0, step))
            if abs(step) < 1e-12:
                break
        return math.exp(t)


@dataclass(frozen=True)
class InverseGaussian(_Positive):
    name: str = "inverse.gaussian"
    link_name: str = "log"
    links = ("log",)

    def variance(self, o, mu):
        return mu * mu * mu

    def variance_slopes(self, o, mu):
        return 3.0 * mu * mu, 6.0 * mu, mu * 0.0 + 6.0

    def deviance(self, o, y, mu):
        return (y - mu) * (y - mu) / (mu * mu * y)

    def likelihood_sums(self, y, w):
        return np.array([np.log(w).sum(), np.log(np.maximum(y, 1e-300)).sum()])

    def saturated(self, phi, n, sums):
        return -0.5 * n * (LOG2PI + math.log(phi)) + 0.5 * sums[0] - 1.5 * sums[1]


@dataclass(frozen=True)
class NegBin(_Positive):
    name: str = "negbin"
    link_name: str = "log"
    theta: float = 2.0
    links = ("log",)
    known_scale = True

    def variance(self, o, mu):
        return mu + mu * mu / self.theta

    def variance_slopes(self, o, mu):
        return 1.0 + 2.0 * mu / self.theta, mu * 0.0 + 2.0 / self.theta, mu * 0.0

    def deviance(self, o, y, mu):
        t = self.theta
        return 2.0 * (safe(o, y > 0, y, lambda v: v * o.log(v / mu), 0.0) - (y + t) * o.log((y + t) / (mu + t)))

    def likelihood_sums(self, y, w):
        t = self.theta
        ylogy = np.where(y > 0, y * np.log(np.where(y > 0, y, 1)), 0.0)
        each = lgamma(NP, y + t) - float(lgamma(NP, np.float64(t))) - lgamma(NP, y + 1.0) + t * math.log(t) + ylogy - (y + t) * np.log(y + t)
        return np.array([(w * each).sum()])

    def saturated(self, phi, n, sums):
        return float(sums[0])


@dataclass(frozen=True)
class Tweedie(_Positive):
    name: str = "tweedie"
    link_name: str = "log"
    p: float = 1.5
    links = ("log",)
    TABLE = 1024
    #: Least and largest log of the positive responses, once a fit knows them.
    span: tuple[float, float] | None = None

    def params(self):
        return {"p": self.p}

    def variance(self, o, mu):
        return o.power(mu, self.p)

    def variance_slopes(self, o, mu):
        p = self.p
        return p * o.power(mu, p - 1), p * (p - 1) * o.power(mu, p - 2), p * (p - 1) * (p - 2) * o.power(mu, p - 3)

    def deviance(self, o, y, mu):
        p = self.p
        first = safe(o, y > 0, y, lambda v: o.power(v, 2 - p) / ((1 - p) * (2 - p)), 0.0)
        return 2.0 * (first - y * o.power(mu, 1 - p) / (1 - p) + o.power(mu, 2 - p) / (2 - p))

    def log_density_at_y(self, y, phi):
        """Saturated log density of each y. Over many distinct y, the series is summed at TABLE values of log y and interpolated
        there: it is smooth in it."""
        out, pos = np.zeros_like(y), y > 0
        v = y[pos]
        if not len(v):
            return out
        u, where = np.unique(v, return_inverse=True)
        if len(u) > self.TABLE:
            at = np.linspace(math.log(u[0]), math.log(u[-1]), self.TABLE)
            out[pos] = np.interp(np.log(v), at, self._series(np.exp(at), phi))
        else:
            out[pos] = self._series(u, phi)[where]
        return out

    def _series(self, v, phi):
        """The compound Poisson-gamma series, summed about its largest term."""
        p = self.p
        alpha = (2 - p) / (1 - p)
        logz = -alpha * np.log(v) + alpha * math.log(p - 1) - (1 - alpha) * math.log(phi) - math.log(2 - p)
        top = np.maximum(1.0, np.round(v ** (2 - p) / ((2 - p) * phi)))
        out, order = np.empty(len(v)), np.argsort(top)
        for part in np.array_split(order, max(1, len(v) // 128)):  # rows of like width together
            reach = int(np.ceil(6 * np.sqrt(top[part].max()) + 30))
            j = top[part][:, None] + np.arange(-reach, reach + 1)[None, :]
            inside = j >= 1
            j = np.maximum(j, 1.0)
            terms = np.where(inside, j * logz[part][:, None] - lgamma(NP, j + 1.0) - lgamma(NP, -alpha * j), -np.inf)
            m = terms.max(1)
            out[part] = m + np.log(np.exp(terms - m[:, None]).sum(1))
        return out - np.log(v) + (v ** (2 - p) / (1 - p) - v ** (2 - p) / (2 - p)) / phi

    def _places(self):
        lo, hi = self.span
        return np.linspace(lo, hi, self.TABLE) if hi > lo else np.array([lo])

    def likelihood_sums(self, y, w):
        """Rows by place: log density is smooth in log y, so a row counts with the two places beside it, and whatever the power
        and the scale, the places' densities are summed afterwards. Without a span, sums of the density over a grid of scales."""
        if self.span is None:
            return np.array([self.log_density_at_y(y, math.exp(t)).sum() for t in self._grid()])
        places, v = self._places(), np.log(y[y > 0])
        if len(places) == 1:
            return np.array([float(len(v))])
        at = np.clip((v - places[0]) / (places[-1] - places[0]) * (len(places) - 1), 0, len(places) - 1)
        low = np.minimum(at.astype(np.int64), len(places) - 2)
        return np.bincount(low, 1 - (at - low), len(places)) + np.bincount(low + 1, at - low, len(places))

    @staticmethod
    def _grid():
        return np.linspace(-5.0, 5.0, 21)

    def _by_scale(self, sums):
        """The log density's sum at each scale of the grid."""
        if self.span is None:
            return sums
        used = sums > 0
        v = np.exp(self._places()[used])
        key = (self.p, self.span, sums.tobytes())
        if _SERIES.get("key") != key:
            _SERIES.update(key=key, value=np.array([self._series(v, math.exp(t)) @ sums[used] if len(v) else 0.0 for t in self._grid()]))
        return _SERIES["value"]

    def saturated(self, phi, n, sums):
        return float(np.interp(math.log(phi), self._grid(), self._by_scale(sums)))

    def scale(self, pdev, n, null, sums):
        grid = np.linspace(-5, 5, 2001)
        value = -pdev / (2 * np.exp(grid)) + np.interp(grid, self._grid(), self._by_scale(sums)) + null / 2 * (LOG2PI + grid)
        return float(math.exp(grid[int(np.argmax(value))]))


#: The last sums by scale, as a search for smoothing parameters asks for the same ones again and again.
_SERIES: dict = {}


@dataclass(frozen=True)
class StudentT(Family):
    name: str = "t-dist"
    nu: float = 5.0
    sigma2: float = 1.0
    known_scale = True
    LEAST_NU = 3.0

    def variance(self, o, mu):
        return mu * 0.0 + self.sigma2

    def deviance(self, o, y, mu):
        r = y - mu
        return (self.nu + 1) * o.log1p(r * r / (self.nu * self.sigma2))

    def weights(self, o, r, kind="em"):
        """Row weights of the residual r: em (nu+1)/(nu s2 + r^2), fisher, or newton, which falls below 0 for outliers."""
        a = self.nu * self.sigma2
        if kind == "fisher":
            return r * 0.0 + (self.nu + 1) / ((self.nu + 3) * self.sigma2)
        if kind == "newton":
            return (self.nu + 1) * (a - r * r) / ((a + r * r) * (a + r * r))
        return (self.nu + 1) / (a + r * r)

    def working(self, o, y, eta, newton=False):
        w = self.weights(o, y - eta)
        return w, w * (y - eta)

    def shape_sums(self, y, eta, w):
        """What slope and curvature of the likelihood in log sigma2 and log nu need of the rows."""
        u = (y - eta) ** 2 / (self.nu * self.sigma2)
        share = u / (1.0 + u)
        return np.array([w.sum(), (w * np.log1p(u)).sum(), (w * share).sum(), (w * share / (1.0 + u)).sum()])

    def shape_step(self, sums) -> "StudentT":
        """One Newton step in log sigma2 and log nu together, of at most 1, with nu within LEAST_NU and 100; itself once it is small."""
        n, logs, share, bend = sums
        v = self.nu
        half = 0.5 * float(digamma((v + 1) / 2) - digamma(v / 2))
        turn = 0.25 * float(trigamma((v + 1) / 2) - trigamma(v / 2))
        g = np.array([-0.5 * n + (v + 1) / 2 * share, n * (v * half - 0.5) - v / 2 * logs + (v + 1) / 2 * share])
        both = v / 2 * share - (v + 1) / 2 * bend
        h = np.array([[-(v + 1) / 2 * bend, both], [both, n * v * (half + v * turn) - v / 2 * logs + v / 2 * share + both]])
        held = (v <= self.LEAST_NU * 1.000001 and g[1] < 0) or (v >= 99.9999 and g[1] > 0)
        if held:
            move = np.array([g[0] / max(abs(h[0, 0]), 1e-300), 0.0])
        else:
            e, q = np.linalg.eigh(h)
            move = (q / np.maximum(np.abs(e), 1e-8 * n)) @ (q.T @ g)
        move *= min(1.0, 1.0 / max(np.abs(move).max(), 1e-300))
        nu = min(max(v * math.exp(move[1]), self.LEAST_NU), 100.0)
        if abs(math.log(nu / v)) < 1e-6 and abs(move[0]) < 1e-8:
            return self
        return replace(self, nu=nu, sigma2=max(self.sigma2 * math.exp(move[0]), 1e-12))

    def likelihood_sums(self, y, w):
        return np.array([w.sum()])

    def saturated(self, phi, n, sums):
        v = self.nu
        c = float(lgamma(NP, np.float64((v + 1) / 2)) - lgamma(NP, np.float64(v / 2)))
        return sums[0] * (c - 0.5 * math.log(math.pi * v * self.sigma2))


@dataclass(frozen=True)
class Quantile(Family):
    """A smoothed check loss at the quantile tau; co is its bandwidth, sigma its scale."""

    name: str = "quantile"
    tau: float = 0.5
    sigma: float = 1.0
    co: float = 0.1
    known_scale = True

    def parts(self, o, y, mu):
        """Deviance D, and the derivatives Dmu, Dmu2, Dmu3 and Dtheta for theta = log sigma."""
        t, lam, s = self.tau, self.co, self.sigma
        r = y - mu
        u = r / lam
        big = (1 - t) * lam * math.log(1 - t) + lam * t * math.log(t) - (1 - t) * r + lam * softplus(o, u)
        p, q = sigmoid(o, u), sigmoid_slope(o, u)
        return 2.0 * big / s, -2.0 * (p - 1.0 + t) / s, 2.0 * q / (lam * s), 2.0 * q * (2.0 * p - 1.0) / (lam * lam * s), -2.0 * big / s

    def deviance(self, o, y, mu):
        t, lam, r = self.tau, self.co, y - mu
        return 2.0 * ((1 - t) * lam * math.log(1 - t) + lam * t * math.log(t) - (1 - t) * r + lam * softplus(o, r / lam)) / self.sigma

    def working(self, o, y, eta, newton=False):
        _, d1, d2, _, _ = self.parts(o, y, eta)
        return o.greatest(0.5 * d2, 1e-10), -0.5 * d1

    def likelihood_sums(self, y, w):
        return np.array([w.sum()])

    def saturated(self, phi, n, sums):
        t, lam, s = self.tau, self.co, self.sigma
        beta = lambda a, b: float(lgamma(NP, np.float64(a)) + lgamma(NP, np.float64(b)) - lgamma(NP, np.float64(a + b)))
        k = lam / s
        return sums[0] * ((1 - t) * k * math.log(1 - t) + k * t * math.log(t) - math.log(lam) - beta(k * (1 - t), k * t))


@dataclass(frozen=True)
class OrderedCategorical(Family):
    """Classes 1..R by thresholds on a logistic latent scale: the first at -1, the others by the gaps exp(theta)."""

    name: str = "ocat"
    theta: tuple[float, ...] = (0.0,)
    known_scale = True

    @property
    def classes(self) -> int:
        return len(self.theta) + 2

    def thresholds(self) -> list[float]:
        out = [-1.0]
        for t in self.theta:
            out.append(out[-1] + math.exp(t))
        return out

    def _ends(self, o, y, eta):
        cuts = self.thresholds()
        lo, hi = y * 0.0 - 40.0, y * 0.0 + 40.0  # offsets from eta that stand for infinity
        for r, c in enumerate(cuts, start=1):
            hi = o.where(y == r, c - eta, hi)
            lo = o.where(y == r + 1, c - eta, lo)
        return lo, hi

    def probability(self, o, eta, r: int):
        cuts = self.thresholds()
        hi = sigmoid(o, cuts[r - 1] - eta) if r < self.classes else eta * 0.0 + 1.0
        lo = sigmoid(o, cuts[r - 2] - eta) if r > 1 else eta * 0.0
        return hi - lo

    def deviance(self, o, y, mu):
        lo, hi = self._ends(o, y, mu)
        # F(hi) - F(lo) without cancellation: 1 - e^(lo - hi) over both logistic denominators.
        return -2.0 * (o.log(-(o.exp(lo - hi) - 1.0)) - softplus(o, -hi) - softplus(o, lo))

    def working(self, o, y, eta, newton=False):
        lo, hi = self._ends(o, y, eta)
        a, b = sigmoid(o, hi), sigmoid(o, lo)
        w = sigmoid_slope(o, hi) + sigmoid_slope(o, lo)  # half the deviance's curvature
        return o.greatest(w, 1e-10), a + b - 1.0  # (f(lo) - f(hi)) / (F(hi) - F(lo)), as f = F (1 - F)

    def observed(self, o, y, eta):
        lo, hi = self._ends(o, y, eta)
        return sigmoid_slope(o, hi) + sigmoid_slope(o, lo)

    def curvature_slope(self, o, y, eta):
        lo, hi = self._ends(o, y, eta)
        return -sigmoid_slope(o, hi) * (1.0 - 2.0 * sigmoid(o, hi)) - sigmoid_slope(o, lo) * (1.0 - 2.0 * sigmoid(o, lo))

    def likelihood_sums(self, y, w):
        return np.array([0.0])

    def saturated(self, phi, n, sums):
        return 0.0


FAMILIES = {
    "gaussian": Gaussian, "binomial": Binomial, "poisson": Poisson, "gamma": Gamma, "Gamma": Gamma, "quasipoisson": QuasiPoisson, "quasibinomial": QuasiBinomial,
    "inverse.gaussian": InverseGaussian, "inverse_gaussian": InverseGaussian, "tweedie": Tweedie, "tw": Tweedie, "Tweedie": Tweedie,
    "negbin": NegBin, "negative.binomial": NegBin, "nb": NegBin, "t-dist": StudentT, "scat": StudentT, "quantile": Quantile, "ocat": OrderedCategorical,
}


def family(name: str, link: str | None = None, **params) -> Family:
    """A family by any of its names; unknown names, links and parameters are refused."""
    if name.startswith("ocat(") and name.endswith(")"):
        return OrderedCategorical(theta=(0.0,) * (int(name[5:-1]) - 2))
    if name not in FAMILIES:
        raise ValueError(f"unknown family {name!r}")
    made = FAMILIES[name](**params)
    if link is not None:
        found = {"reciprocal": "inverse"}.get(link, link)
        if found not in made.links:
            raise ValueError(f"family {name} takes the links {', '.join(made.links)}, not {link!r}")
        made = replace(made, link_name=found)
    if isinstance(made, Tweedie) and not 1 < made.p < 2:
        raise ValueError("tweedie needs 1 < p < 2")
    if isinstance(made, Quantile) and not 0 < made.tau < 1:
        raise ValueError("quantile needs 0 < tau < 1")
    return made
