"""Dense algebra on the driver, for matrices of a few hundred columns."""

from __future__ import annotations

import numpy as np


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a x = b for a symmetric positive semi-definite a: pivoted Cholesky of the scaled matrix; pivots that vanish get 0."""
    scale = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
    l, piv, rank = pivoted_cholesky(a * scale[:, None] * scale[None, :])
    p = piv[:rank]
    z = np.linalg.solve(l[:rank, :rank], (b.T * scale).T[p])
    x = np.zeros_like(b, dtype=np.float64)
    x[p] = np.linalg.solve(l[:rank, :rank].T, z)
    return (x.T * scale).T


def pivoted_cholesky(a: np.ndarray, tol: float = 1e-14) -> tuple[np.ndarray, np.ndarray, int]:
    """L, pivots and rank, such that a[pivots][:, pivots] = L L' up to the tolerance."""
    a, n = a.copy(), len(a)
    piv, l, d = np.arange(n), np.zeros((n, n)), np.diag(a).copy()
    floor = tol * max(d.max(initial=0), 1e-300) * n
    for k in range(n):
        j = k + int(np.argmax(d[piv[k:]]))
        if d[piv[j]] <= floor:
            return l, piv, k
        piv[[k, j]] = piv[[j, k]]
        l[[k, j], :k] = l[[j, k], :k]
        l[k, k] = np.sqrt(d[piv[k]])
        rest = piv[k + 1 :]
        l[k + 1 :, k] = (a[rest, piv[k]] - l[k + 1 :, :k] @ l[k, :k]) / l[k, k]
        d[rest] -= l[k + 1 :, k] ** 2
    return l, piv, n


def inverse(a: np.ndarray) -> np.ndarray:
    return solve(a, np.eye(len(a)))


def logdet(a: np.ndarray) -> float:
    """Sum of the logs of the sizes of the eigenvalues of a symmetric matrix."""
    return float(np.log(np.maximum(np.abs(np.linalg.eigvalsh(a)), 1e-300)).sum())


def rank_and_logdet(s: np.ndarray) -> tuple[int, float]:
    """Rank of a penalty by its eigenvalues over eps^0.8 of the largest, and their log product."""
    e = np.linalg.eigvalsh(s) if s.size else np.zeros(0)
    e = e[e > max(e.max(initial=0), 0) * np.finfo(float).eps ** 0.8] if len(e) and e.max() > 0 else e[:0]
    return len(e), float(np.log(e).sum())


def root(s: np.ndarray) -> np.ndarray:
    """R with R R' = s."""
    e, v = np.linalg.eigh(s)
    return v * np.sqrt(np.maximum(e, 0))


def stacked_r(blocks: list[np.ndarray]) -> np.ndarray:
    """The triangular factor of stacked blocks, block by block: for designs whose Gram matrix is too ill-conditioned. Square, with rows
    of zeros below where all blocks together have fewer rows than columns."""
    r = np.zeros((0, blocks[0].shape[1]))
    for b in blocks:
        r = np.linalg.qr(np.vstack([r, b]), mode="r")
    return np.vstack([r, np.zeros((max(r.shape[1] - len(r), 0), r.shape[1]))])


def brent(f, lo: float, hi: float, tol: float = 1e-8, most: int = 100) -> tuple[float, float]:
    """Minimum of f on [lo, hi] by golden sections with parabolic steps."""
    gold = (3 - 5**0.5) / 2
    x = w = v = lo + gold * (hi - lo)
    fx = fw = fv = f(x)
    d = e = 0.0
    for _ in range(most):
        mid, eps = 0.5 * (lo + hi), tol * abs(x) + 1e-12
        if abs(x - mid) <= 2 * eps - 0.5 * (hi - lo):
            break
        parabola = False
        if abs(e) > eps:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p = (x - v) * q - (x - w) * r
            q = 2 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
            if abs(p) < abs(0.5 * q * e) and q * (lo - x) < p < q * (hi - x):
                e, d, parabola = d, p / q, True
        if not parabola:
            e = (lo - x) if x >= mid else (hi - x)
            d = gold * e
        u = x + (d if abs(d) >= eps else (eps if d > 0 else -eps))
        fu = f(u)
        if fu <= fx:
            lo, hi = (x, hi) if u >= x else (lo, x)
            v, w, x, fv, fw, fx = w, x, u, fw, fx, fu
        else:
            lo, hi = (u, hi) if u < x else (lo, u)
            if fu <= fw or w == x:
                v, w, fv, fw = w, u, fw, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x, fx


def bfgs(f, x0: np.ndarray, grad=None, tol: float = 1e-6, most: int = 200, step: float = 1e-4, cap: float = 5.0, first: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Minimum of f by quasi-Newton steps with halving; the gradient is taken by central differences if none is given. first: an
    inverse curvature to begin with."""
    def slope(x):
        if grad is not None:
            return grad(x)
        return np.array([(f(x + step * e) - f(x - step * e)) / (2 * step) for e in np.eye(len(x))])

    x, fx = np.array(x0, np.float64), f(x0)
    g, h = slope(x), np.eye(len(x0)) if first is None else first
    for _ in range(most):
        if np.abs(g).max(initial=0) < tol * (abs(fx) + 1):
            break
        move = -h @ g
        if move @ g >= 0:
            h, move = np.eye(len(x)), -g
        move *= min(1.0, cap / max(np.linalg.norm(move), 1e-300))
        a = 1.0
        while a > 1e-8:
            new, fn = x + a * move, f(x + a * move)
            if np.isfinite(fn) and fn <= fx + 1e-4 * a * (move @ g):
                break
            a /= 2
        else:
            break
        gn = slope(new)
        s, y = new - x, gn - g
        if s @ y > 1e-12:
            i, r = np.eye(len(x)), 1 / (s @ y)
            h = (i - r * np.outer(s, y)) @ h @ (i - r * np.outer(y, s)) + r * np.outer(s, s)
        done = abs(fx - fn) < 1e-10 * (abs(fx) + 1)
        x, fx, g = new, fn, gn
        if done:
            break
    return x, fx
