"""The same Gaussian fit for rows that are in memory already, such as a group's."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from ..functions.families import family as make_family
from . import linalg, select
from .fit import TARGET, WEIGHT, Design, Options, Profile, Statistics, _iterate, _seeded, constrain, place
from .model import GamModel
from .rows import LocalRows
from .select import Working
from .terms import Term


def fit_rows(pdf: pd.DataFrame, target: str, terms: list[Term], fam="gaussian", weight: str | None = None, opt: Options | None = None) -> GamModel:
    opt = opt or Options()
    fam = make_family(fam) if isinstance(fam, str) else fam
    y = pdf[target].to_numpy(np.float64)
    p = Profile(len(y), float(len(y)), {}, {}, {}, y={"mean": float(y.mean()), "var": float(y.var(ddof=1)) if len(y) > 1 else 0.0, "min": float(y.min()), "max": float(y.max()), "sum": float(y.sum())})
    cols = {TARGET: y, WEIGHT: pdf[weight].to_numpy(np.float64) if weight else np.ones(len(y))}
    for t in terms:
        if t.kind == "re":
            p.levels[t.name] = sorted(pdf[t.name].dropna().unique().tolist())
            cols[t.name] = pdf[t.name].to_numpy()
            continue
        x = pdf[t.name].to_numpy(np.float64)
        u = np.unique(x)
        p.lo[t.name], p.hi[t.name], p.mean[t.name], p.unique[t.name] = float(u[0]), float(u[-1]), float(x.mean()), len(u)
        if t.kind in ("cr", "tps") and opt.knots == "quantile":
            p.knots[t.name] = np.quantile(u, np.linspace(0, 1, t.k))
        cols[t.name] = x
    place(terms, p, opt.knots)
    rows = LocalRows(cols)
    constrain(rows, terms, p.n)
    stats = Statistics(rows, Design(terms), fam)
    pen = stats.design.penalties
    fam = _seeded(fam, p, stats)
    method = opt.method or "REML"
    if fam.name == "gaussian":
        s = stats.at(None, fam)
        w = Working(s["g"], s["r"], s["zz"], s["n"])
        rho = np.log(np.asarray(opt.lam)) if opt.lam is not None else select.choose(w, pen, method)
        beta = w.beta(pen, np.exp(rho))
        score, phi, its, dev = w.reml(pen, rho, None, s["log_weights"]), 1.0, 1, w.rss(beta)
    else:
        beta, rho, s, fam, score, phi, its = _iterate(stats, fam, pen, method, opt.algorithm or "newton", None if opt.lam is None else np.log(np.asarray(opt.lam)), opt, p, True)
        w, dev = Working(s["g"], s["r"], s["zz"], s["n"]), s["dev"]
    a = select.ridged(w.g) + pen.total(np.exp(rho))
    edf = np.diag(linalg.solve(a, w.g))
    scale = 1.0 if fam.known_scale else float(dev / max(p.n - edf.sum(), 1e-8)) if fam.name == "gaussian" else phi
    return GamModel(terms=terms, fam=fam, target=target, weight=weight, beta=beta, vcov=scale * linalg.inverse(a), lam=np.exp(rho), edf=edf, scale=scale, deviance=float(dev), score_value=float(score), method=method,
                    iterations=its, gram=w.g, rhs=w.r, zz=w.zz, rows=p.n, training={"n": p.n, "mean": p.mean, "lo": p.lo, "hi": p.hi, "y_mean": p.y["mean"]}, reml_scale=float(phi) if math.isfinite(phi) else 1.0)
