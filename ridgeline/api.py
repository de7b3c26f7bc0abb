"""Estimators: `Gam` for named columns of DataFrames, `GAM` for formulas and term lists."""

from __future__ import annotations

import copy
import math
import warnings
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.families import Family, Tweedie, family as make_family
from .operators.diagnostics import k_index
from .operators.fit import Options, fit_gam
from .operators.model import GamModel
from .operators.predictor import Predictor
from .operators.quantile import fit_location_scale, fit_quantile
from .operators.terms import Term
from .sources.formula import parse, term
from .sources.frames import ingest, with_response

#: Canonical links of families that allow several.
CANONICAL = {"gamma": "inverse", "Gamma": "inverse"}


class Gam:
    """A smooth of each predictor.

    k, bs and pc are one value or a value by column name. parametric: columns that enter linearly. random: columns whose levels
    get a shrunken intercept each. family parameters (theta, p, df, tau, sigma, co, r) go by name. auto_k: k grows by half while
    the k-index stays under 0.95, in five fits at most.
    """

    def __init__(self, predictors: list[str] | None = None, family: str | Family = "gaussian", link: str | None = None, k: int | dict = 10, bs: str | dict = "cr", pc: dict | None = None,
                 parametric: list[str] | None = None, random: list[str] | None = None, method: str | None = None, algorithm: str | None = None, discrete: bool = False, auto_k: bool = False,
                 k_threshold: float = 0.95, max_k: int = 100, options: Options | None = None, **params):
        self.predictors, self.k, self.bs, self.pc = predictors, k, bs, pc or {}
        self.parametric, self.random = parametric or [], random or []
        params = {{"df": "nu"}.get(a, a): v for a, v in params.items()}
        r = params.pop("r", None)
        self.profile_shape = not any(p in params for p in ("nu", "theta", "p"))
        self.fam = family if isinstance(family, Family) else make_family(f"ocat({r})" if family == "ocat" and r else family, link or CANONICAL.get(family), **params)
        self.options = replace(options or Options(), **{a: v for a, v in (("method", method), ("algorithm", algorithm)) if v is not None}, discrete=discrete or (options.discrete if options else False), profile_p=isinstance(self.fam, Tweedie) and "p" not in params)
        self.auto_k, self.k_threshold, self.max_k = auto_k, k_threshold, max_k
        self.auto_k_trace: list[dict] = []
        self.model: GamModel | None = None

    def _terms(self, names: list[str], k: dict | None = None) -> list[Term]:
        of = lambda v, n, d: v.get(n, d) if isinstance(v, dict) else v
        out = []
        for n in names:
            kind = "parametric" if n in self.parametric else "re" if n in self.random else of(self.bs, n, "cr")
            out.append(term(n, kind, (k or {}).get(n, of(self.k, n, 10)), self.pc.get(n)))
        return out

    def fit(self, x, y, sample_weight=None) -> "Gam":
        """x: a DataFrame, with y (and weights) named; or a pandas frame or array with the values."""
        spark = x.sparkSession if isinstance(x, DataFrame) else SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        df = with_response(spark, x, y, weight=sample_weight)
        target = y if isinstance(y, str) else "y"
        weight = sample_weight if isinstance(sample_weight, str) else ("weight" if sample_weight is not None else None)
        names = self.predictors or [c for c in df.columns if c not in (target, weight)]
        names = names + [c for c in [*self.parametric, *self.random] if c not in names]
        self.feature_names = names
        k: dict = {}
        for _ in range(6):
            self.model = fit_gam(df, target, self._terms(names, k), self.fam, weight, self.options, profile_shape=self.profile_shape)
            if not self.auto_k or len(self.auto_k_trace) >= 5:
                break
            grown = self._grown(df, target)
            if not grown:
                break
            k |= grown
        return self

    def _grown(self, df: DataFrame, target: str) -> dict[str, int]:
        m = self.model
        scored = m.transform(df).withColumn("__tie", F.monotonically_increasing_id())
        found, out = {}, {}
        for t in m.terms:
            if t.kind in ("cr", "bs", "tps"):
                found[t.name] = k_index(scored, t.name, F.col(target) - F.col("prediction"), "__tie")
                bigger = min(math.ceil(t.k * 1.5), self.max_k, max(m.rows // 4, t.k))
                if found[t.name] < self.k_threshold and bigger > t.k:
                    out[t.name] = bigger
        self.auto_k_trace.append({"k": {t.name: t.k for t in m.terms}, "k_index": found})
        return out

    def __getitem__(self, names) -> GamModel:
        return self.model[names]

    def _frame(self, x) -> DataFrame:
        return ingest(SparkSession.getActiveSession(), x, None if isinstance(x, DataFrame) else self.feature_names)

    def predict(self, x, kind: str = "response") -> DataFrame:
        return self.model.transform(self._frame(x), kind)

    def predict_terms(self, x) -> DataFrame:
        return self.model.transform_terms(self._frame(x))

    def predict_ci(self, x, **kw) -> DataFrame:
        return self.model.transform_ci(self._frame(x), **kw)

    def predict_proba(self, x) -> DataFrame:
        return self.model.probabilities(self._frame(x))

    def predict_diff(self, left, right, on: str | None = None) -> DataFrame:
        return self.model.diff(self._frame(left), self._frame(right), on)

    def predict_change(self, start, end, on: str | None = None, broadcast: str = "none", level: float | None = None) -> DataFrame:
        """prediction(end) - prediction(start); see GamModel.change."""
        return self.model.change(self._frame(start), self._frame(end), on, broadcast, level)

    def partial_effect(self, name: str, n: int = 100) -> DataFrame:
        return self.model.partial_effect(SparkSession.getActiveSession(), name, n)

    def plot(self, name: str, n: int = 100):
        """The partial effect with its band, if a plotting library is there."""
        try:
            import matplotlib.pyplot as plt
        except ImportError as e:
            raise RuntimeError("plotting needs matplotlib") from e
        pdf = self.partial_effect(name, n).toPandas().sort_values(name)
        _, ax = plt.subplots()
        ax.plot(pdf[name], pdf["effect"])
        ax.fill_between(pdf[name], pdf["lower"], pdf["upper"], alpha=0.3)
        ax.set(xlabel=name, ylabel=f"s({name})")
        return ax

    def score(self, df: DataFrame) -> float:
        return self.model.score(df)

    def summary(self, df: DataFrame) -> dict:
        return self.model.summary(df)


class GAM:
    """Formulas and term lists onto the same fit; family parameters as in Gam."""

    def __init__(self, family: str = "gaussian", link: str | None = None, **params):
        self.inner = Gam(family=family, link=link, **params)
        self.terms: list[Term] = []
        self.model: GamModel | None = None

    def add_smooth(self, name: str, k: int = 10, bs: str = "cr", pc: float | None = None) -> "GAM":
        self.terms.append(term(name, bs, k, pc))
        return self

    add_cubic_spline = add_smooth

    def fit_formula(self, formula: str, df: DataFrame, target: str | None = None, weight: str | None = None, **options) -> GamModel:
        left, terms = parse(formula)
        return self._fit(df, target or left, terms, weight, options)

    def fit_auto(self, df: DataFrame, target: str, k: int | list[int] = 10, bs: str = "cr", weight: str | None = None, **options) -> GamModel:
        """A smooth of every other column; k is one number or one for each."""
        names = [c for c in df.columns if c not in (target, weight)]
        ks = [k] * len(names) if isinstance(k, int) else list(k)
        if len(ks) != len(names):
            raise ValueError(f"k needs {len(names)} values")
        return self._fit(df, target, [term(n, bs, q) for n, q in zip(names, ks)], weight, options)

    fit = fit_auto

    def fit_manual(self, df: DataFrame, target: str, lam: list[float] | None = None, weight: str | None = None, **options) -> GamModel:
        """The terms that were added, at given smoothing parameters if any."""
        if not self.terms:
            raise ValueError("no terms were added")
        return self._fit(df, target, copy.deepcopy(self.terms), weight, {**options, "lam": lam})

    def _fit(self, df, target, terms, weight, options):
        if target is None:
            raise ValueError("name the response")
        self.model = fit_gam(df, target, terms, self.inner.fam, weight, replace(self.inner.options, **options), profile_shape=self.inner.profile_shape)
        return self.model


def grouped_fit(df: DataFrame, by: str, formula: str, family: str = "gaussian") -> DataFrame:
    """by, model (JSON) and edf: one small model for each group, all fitted in parallel. A group's rows must fit in a task."""
    from .operators.local import fit_rows

    target, terms = parse(formula)
    kind = df.schema[by].dataType.simpleString()
    names = list(dict.fromkeys([by, target, *[t.name for t in terms]]))

    def run(pdf):
        import pandas as pd

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            m = fit_rows(pdf, target, copy.deepcopy(terms), family)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "model": [m.to_json()], "edf": [m.edf_total]})

    return df.select(*names).groupBy(by).applyInPandas(run, f"`{by}` {kind}, model string, edf double")


__all__ = ["GAM", "Gam", "GamModel", "Options", "Predictor", "fit_location_scale", "fit_quantile", "grouped_fit"]
