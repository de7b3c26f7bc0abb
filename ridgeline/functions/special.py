"""Gamma-family and normal functions for numpy and for Spark columns; neither has them all built in."""

from __future__ import annotations

import math

import numpy as np

#: Coefficients of the Stirling series of log gamma, B_2k / (2k (2k - 1)).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
SHIFT = 8


def lgamma(o, x):
    """log gamma for x > 0: the argument is raised above SHIFT by the recurrence, and the series taken there."""
    rising = o.lit(1.0)
    for i in range(SHIFT):
        rising = rising * (x + float(i))
    z = x + float(SHIFT)
    series, inv, z2 = o.lit(0.0), 1.0 / z, 1.0 / (z * z)
    for c in STIRLING:
        series = series + c * inv
        inv = inv * z2
    return (z - 0.5) * o.log(z) - z + 0.5 * math.log(2 * math.pi) + series - o.log(rising)


def digamma(x):
    x = np.asarray(x, np.float64)
    out = np.zeros_like(x)
    for _ in range(SHIFT):
        small = x < SHIFT
        out = np.where(small, out - 1 / x, out)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y * (5 / 660)))))


def trigamma(x):
    x = np.asarray(x, np.float64)
    out = np.zeros_like(x)
    for _ in range(SHIFT):
        small = x < SHIFT
        out = np.where(small, out + 1 / (x * x), out)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def sigmoid(o, x):
    """1 / (1 + e^-x) without overflow on either side."""
    e = o.exp(-o.abs(x))
    return o.where(x >= 0, 1.0 / (1.0 + e), e / (1.0 + e))


def sigmoid_slope(o, x):
    """s (1 - s), which keeps its digits in both tails."""
    e = o.exp(-o.abs(x))
    return e / ((1.0 + e) * (1.0 + e))


def softplus(o, x):
    return o.greatest(x, 0.0) + o.log1p(o.exp(-o.abs(x)))


def norm_cdf(x):
    return np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))(x)


def norm_ppf(p: float) -> float:
    """Inverse of the normal distribution function by bisection and Newton steps on it."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    lo, hi = -40.0, 40.0
    x = 0.0
    for _ in range(200):
        f = 0.5 * math.erfc(-x / math.sqrt(2)) - p
        lo, hi = (x, hi) if f < 0 else (lo, x)
        slope = math.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)
        step = x - f / slope if slope > 1e-300 else math.inf
        new = step if lo < step < hi else 0.5 * (lo + hi)
        if abs(new - x) < 1e-15 * max(1, abs(x)):
            return new
        x = new
    return x
