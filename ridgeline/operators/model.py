"""Fitted models: immutable, portable, and scored over DataFrames by column name."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.families import Family, family as make_family
from ..functions.ops import NP, SP
from ..functions.special import norm_ppf
from .terms import Term, restored

DRAWS, SEED = 1000, 42
#: Bytes of posterior draws, one set for each tuple of covariates, up to which they are computed once and broadcast.
SHIPPED = 64 << 20


@dataclass(frozen=True)
class GamModel:
    terms: list[Term]
    fam: Family
    target: str
    weight: str | None
    beta: np.ndarray
    vcov: np.ndarray
    lam: np.ndarray
    edf: np.ndarray
    scale: float
    deviance: float
    score_value: float
    method: str
    iterations: int
    gram: np.ndarray
    rhs: np.ndarray
    zz: float
    rows: int
    training: dict
    reml_scale: float = 1.0
    #: Indices of the terms in view, and whether the intercept is.
    view: tuple[int, ...] | None = None
    intercept_in_view: bool = True

    # -- attributes -----------------------------------------------------------------------------------------------------

    @property
    def names(self) -> list[str]:
        return [t.name for t in self.terms]

    @property
    def active(self) -> list[int]:
        return list(range(len(self.terms))) if self.view is None else list(self.view)

    def span(self, i: int) -> slice:
        at = 1 + sum(t.size for t in self.terms[:i])
        return slice(at, at + self.terms[i].size)

    @property
    def intercept(self) -> float:
        return float(self.beta[0])

    @property
    def coef(self) -> dict[str, np.ndarray]:
        return {self.terms[i].name: self.beta[self.span(i)] for i in self.active}

    @property
    def smoothing(self) -> dict[str, float]:
        named = [t.name for t in self.terms if t.penalised]
        return dict(zip(named, self.lam.tolist()))

    @property
    def edf_by_term(self) -> dict[str, float]:
        return {self.terms[i].name: float(self.edf[self.span(i)].sum()) for i in self.active}

    @property
    def edf_total(self) -> float:
        return float(self.edf.sum())

    def __getitem__(self, names) -> "GamModel":
        """A view of some terms; "intercept" among the names keeps the intercept."""
        names = [names] if isinstance(names, str) else list(names)
        unknown = [n for n in names if n != "intercept" and n not in self.names]
        if unknown:
            raise KeyError(f"no terms named {', '.join(unknown)}; there are {', '.join(self.names)}")
        return replace(self, view=tuple(i for i in self.active if self.terms[i].name in names), intercept_in_view="intercept" in names)

    # -- scoring --------------------------------------------------------------------------------------------------------

    def _check(self, df: DataFrame) -> None:
        missing = [self.terms[i].name for i in self.active if self.terms[i].name not in df.columns]
        if missing:
            raise ValueError(f"columns not found: {', '.join(dict.fromkeys(missing))}")

    def term_column(self, i: int) -> Column:
        t = self.terms[i]
        x = F.col(t.name)
        return t.column(x if t.kind == "re" else x.cast("double"), self.beta[self.span(i)])

    def eta(self, prior: Column | None = None) -> Column:
        parts = [self.term_column(i) for i in self.active]
        base = F.lit(self.intercept if self.intercept_in_view else 0.0)
        return reduce(lambda a, b: a + b, parts, base if prior is None else prior + base)

    def transform(self, df: DataFrame, kind: str = "response", column: str = "prediction") -> DataFrame:
        """df with the prediction: response, link, or deviation (the view's terms without the intercept). Terms out of view
        aren't computed, so their columns needn't be read."""
        self._check(df)
        eta = self.eta()
        if kind == "deviation":
            return df.withColumn(column, replace(self, intercept_in_view=False).eta())
        return df.withColumn(column, eta if kind == "link" else self.fam.mean(SP, eta))

    def transform_terms(self, df: DataFrame, prefix: str = "f_") -> DataFrame:
        """df with each term on the link scale, the intercept and their total."""
        self._check(df)
        out = df.withColumns({f"{prefix}{self.terms[i].name}": self.term_column(i) for i in self.active})
        total = reduce(lambda a, b: a + b, [F.col(f"{prefix}{self.terms[i].name}") for i in self.active], F.lit(self.intercept if self.intercept_in_view else 0.0))
        return out.withColumn("intercept", F.lit(self.intercept if self.intercept_in_view else 0.0)).withColumn("total", total)

    def probabilities(self, df: DataFrame) -> DataFrame:
        """p0, p1 for binomial families; p1 to pR for ordered categories."""
        self._check(df)
        if self.fam.name == "ocat":
            return df.withColumns({f"p{r}": self.fam.probability(SP, self.eta(), r) for r in range(1, self.fam.classes + 1)})
        if self.fam.name not in ("binomial", "quasibinomial"):
            raise ValueError(f"family {self.fam.name} has no class probabilities")
        p = self.fam.mean(SP, self.eta())
        return df.withColumns({"p0": 1.0 - p, "p1": p})

    def design(self, cols: dict[str, np.ndarray]) -> np.ndarray:
        """Rows of the prediction matrix, with zeros for what is out of view."""
        n = len(next(iter(cols.values()))) if cols else 1
        out = np.zeros((n, len(self.beta)))
        out[:, 0] = 1.0 if self.intercept_in_view else 0.0
        for i in self.active:
            out[:, self.span(i)] = self.terms[i].block(np.asarray(cols[self.terms[i].name]))
        return out

    def design_frame(self, df: DataFrame, column: str = "lp") -> DataFrame:
        return self._arrow(df, lambda m: {column: list(m)}, f"{column} array<double>")

    def _arrow(self, df: DataFrame, f, added: str) -> DataFrame:
        self._check(df)
        names = list(dict.fromkeys(self.terms[i].name for i in self.active))
        kinds = {self.terms[i].name: self.terms[i].kind for i in self.active}
        model = self

        def run(it):
            for pdf in it:
                m = model.design({c: pdf[c].to_numpy() if kinds[c] == "re" else pdf[c].to_numpy(np.float64) for c in names} or {"": np.zeros(len(pdf))})
                yield pdf.assign(**f(m))

        schema = ", ".join(f"`{s.name}` {s.dataType.simpleString()}" for s in df.schema)
        return df.mapInPandas(run, f"{schema}, {added}")

    def draws(self, n: int = DRAWS, seed: int = SEED) -> np.ndarray:
        """Coefficient vectors from the posterior normal, one a row."""
        e, v = np.linalg.eigh((self.vcov + self.vcov.T) / 2)
        z = np.random.default_rng(seed).standard_normal((n, len(e)))
        return self.beta + z * np.sqrt(np.maximum(e, 0)) @ v.T

    def posterior(self, df: DataFrame, n: int = DRAWS, seed: int = SEED, column: str = "samples") -> DataFrame:
        """df with n draws of its prediction in every row. Rows of equal covariates have equal draws and come one after another within each
        partition, so that files written from them hold little more than each one's draws. Where tuples of covariates are few, by one job
        that counts them, each one's draws are computed once and joined to its rows; else each row's are."""
        b, link = self.draws(n, seed), self.fam.link
        names = list(dict.fromkeys(self.terms[i].name for i in self.active))
        self._check(df)
        f, added = (lambda m: {column: list(link.inverse(NP, m @ b.T))}), f"{column} array<double>"
        if not names:
            return self._arrow(df, f, added)
        # NaN is null in what pandas gives back, and both are one to the draws.
        kinds = dict(df.select(*names).dtypes)
        key = {c: F.when(~F.isnan(c), F.col(c)) if kinds[c] in ("float", "double") else F.col(c) for c in names}
        most, tuples = max(SHIPPED // (8 * max(n, 1)), 1), df.select(*[key[c].alias(c) for c in names]).distinct()
        if tuples.limit(most + 1).count() > most:
            return self._arrow(df.sortWithinPartitions(*names), f, added)
        own = {c: f"__t_{i}" for i, c in enumerate(names)}
        drawn = F.broadcast(self._arrow(tuples, f, added).withColumnsRenamed(own))
        # Sorts under a join are dropped as needless; a condition that isn't deterministic keeps this one.
        rows = df.sortWithinPartitions(*names).where(F.monotonically_increasing_id() >= 0)
        same = [key[c].eqNullSafe(F.col(t)) for c, t in own.items()]
        return rows.join(drawn, same, "left").drop(*own.values())

    def transform_ci(self, df: DataFrame, level: float = 0.95, kind: str = "response", method: str = "normal", n: int = DRAWS, seed: int = SEED) -> DataFrame:
        """df with prediction, se (link scale), lower and upper. normal: eta +- z se; sample: quantiles of posterior draws.
        Bounds are put in order, as a decreasing link swaps them."""
        z, fam = norm_ppf(0.5 + level / 2), self.fam
        b = self.draws(n, seed) if method == "sample" else None
        out = (lambda e: fam.mean(NP, e)) if kind == "response" else (lambda e: e)

        def bounds(m):
            eta, se = m @ self.beta, np.sqrt(np.maximum(((m @ self.vcov) * m).sum(1), 0))
            lo, hi = (eta - z * se, eta + z * se) if b is None else np.quantile(m @ b.T, [0.5 - level / 2, 0.5 + level / 2], axis=1)
            lo, hi = out(lo), out(hi)
            return {"prediction": out(eta), "se": se, "lower": np.minimum(lo, hi), "upper": np.maximum(lo, hi)}

        return self._arrow(df, bounds, "prediction double, se double, lower double, upper double")

    def diff(self, left: DataFrame, right: DataFrame, on: str | None = None, level: float = 0.95) -> DataFrame:
        """prediction(left) - prediction(right) on the link scale with its interval: rows paired by `on`, or against right's only row;
        without `on`, a right side of any other number of rows is refused."""
        self._check(left), self._check(right)
        names = list(dict.fromkeys(self.terms[i].name for i in self.active))
        other = right.select(*([on] if on else []), *[F.col(c).alias(f"__r_{c}") for c in names])
        if not on and (n := other.limit(2).count()) != 1:
            raise ValueError(f"without `on` the right side needs one row, and has {'none' if not n else 'several'}")
        both = left.join(other, on) if on else left.join(F.broadcast(other))
        z, model = norm_ppf(0.5 + level / 2), self

        def run(it):
            for pdf in it:
                m = model.design({c: pdf[c].to_numpy() for c in names}) - model.design({c: pdf[f"__r_{c}"].to_numpy() for c in names})
                d, se = m @ model.beta, np.sqrt(np.maximum(((m @ model.vcov) * m).sum(1), 0))
                yield pdf.drop(columns=[f"__r_{c}" for c in names]).assign(diff=d, se=se, lower=d - z * se, upper=d + z * se)

        schema = ", ".join(f"`{s.name}` {s.dataType.simpleString()}" for s in left.schema)
        if on:
            both = both.select(*left.columns, *[f"__r_{c}" for c in names])
        return both.mapInPandas(run, f"{schema}, diff double, se double, lower double, upper double")

    def change(self, start: DataFrame, end: DataFrame, on: str | None = None, broadcast: str = "none", level: float | None = None) -> DataFrame:
        """prediction(end) - prediction(start) for models with the identity link, as `diff`, and with a level its interval.

        broadcast: none pairs rows by `on`, a key that each side has once for each of its rows, the same keys on both; from sets the one
        row of start against every row of end; to the one row of end against every row of start. The columns are those of end, or of
        start for to. Without a level, no Python runs: both predictions are expressions."""
        if self.fam.link_name != "identity":
            raise NotImplementedError(f"differences on the response scale need the identity link, not {self.fam.link_name}; diff() gives those on the link scale")
        if broadcast not in ("none", "from", "to"):
            raise ValueError(f"broadcast must be none, from or to, not {broadcast!r}")
        if (on is None) == (broadcast == "none"):
            raise ValueError("rows are paired by `on`, or one row is broadcast")
        if level is not None and not 0 < level < 1:
            raise ValueError("level must lie between 0 and 1")
        self._check(start), self._check(end)
        rows, other, sign = (start, end, -1.0) if broadcast == "to" else (end, start, 1.0)
        if broadcast == "none":
            keys = rows.groupBy(on).agg(F.count("*").alias("a")).join(other.groupBy(on).agg(F.count("*").alias("b")), on, "full")
            bad = keys.where(~(F.col("a").eqNullSafe(1) & F.col("b").eqNullSafe(1)) | F.col(on).isNull()).count()
            if bad:
                raise ValueError(f"{bad} keys aren't on both sides exactly once")
        elif (n := other.limit(2).count()) != 1:
            raise ValueError(f"broadcast={broadcast!r} needs one row there, and there are {'none' if not n else 'several'}")
        if level is None:
            theirs = self.transform(other, column="__other").select(*([on] if on else []), "__other")
            both = self.transform(rows, column="__own").join(theirs if on else F.broadcast(theirs), **({"on": on} if on else {}))
            return both.select(*[both[c] for c in rows.columns], (F.lit(sign) * (F.col("__own") - F.col("__other"))).alias("diff"))
        out = self.diff(rows, other, on, level)
        if sign < 0:
            out = out.withColumns({"diff": -F.col("diff"), "lower": -F.col("upper"), "upper": -F.col("lower")})
        return out

    def partial_effect(self, spark: SparkSession, name: str, n: int = 100, level: float = 0.95) -> DataFrame:
        """The term over an even grid of its training range, the other columns at their means."""
        i = self.names.index(name)
        lo, hi = self.training["lo"][name], self.training["hi"][name]
        grid = spark.range(n).select((F.lit(lo) + F.col("id") * F.lit((hi - lo) / max(n - 1, 1))).alias(name))
        view = replace(self, view=(i,), intercept_in_view=False)
        return view.transform_ci(grid, level, kind="link").withColumnRenamed("prediction", "effect")

    # -- diagnostics ----------------------------------------------------------------------------------------------------

    def summary(self, df: DataFrame) -> dict:
        """family, link, n, scale, deviance, total edf and, for the Gaussian, adjusted R squared; the degrees are the whole model's."""
        r = self._residual_sums(df)
        out = {"family": self.fam.name, "link": self.fam.link_name, "n": r["n"], "scale": self.scale, "deviance": self.deviance, "edf": self.edf_total, "terms": self.edf_by_term}
        if self.fam.name == "gaussian":
            out["r2_adjusted"] = 1 - (r["rss"] / max(r["n"] - self.edf_total, 1e-8)) / max(r["tss"] / max(r["n"] - 1, 1), 1e-300)
        return out

    def summary_frame(self, spark: SparkSession) -> DataFrame:
        """One row a term: kind, k, lambda, edf."""
        lam = self.smoothing
        rows = [(t.name, t.kind, t.k if t.kind not in ("re", "parametric") else t.size, float(lam.get(t.name, 0.0)), self.edf_by_term.get(t.name)) for i, t in enumerate(self.terms) if i in self.active]
        return spark.createDataFrame(rows, "term string, kind string, k int, lambda double, edf double")

    def _residual_sums(self, df: DataFrame):
        scored = self.transform(df.where(F.col(self.target).isNotNull()))
        y = F.col(self.target).cast("double")
        return scored.agg(F.count("*").alias("n"), F.sum((y - F.col("prediction")) ** 2).alias("rss"), (F.var_pop(y) * F.count(y)).alias("tss"), F.avg(((F.col("prediction") >= 0.5) == (y >= 0.5)).cast("double")).alias("hit")).first()

    def score(self, df: DataFrame) -> float:
        """R squared, or for binomial families the share of rows that a cut at 0.5 gets right."""
        r = self._residual_sums(df)
        return float(r["hit"]) if self.fam.name in ("binomial", "quasibinomial") else float(1 - r["rss"] / max(r["tss"], 1e-300))

    def check_against(self, other: "GamModel", df: DataFrame, rtol: float = 1e-10) -> bool:
        """Whether both models predict alike over df."""
        a = self.transform(df, column="__a").withColumn("__b", other.fam.mean(SP, other.eta()))
        r = a.agg(F.max(F.abs(F.col("__a") - F.col("__b")) / (1e-300 + F.greatest(F.abs("__a"), F.abs("__b")))).alias("d")).first()
        return r["d"] is None or r["d"] <= rtol

    # -- persistence ----------------------------------------------------------------------------------------------------

    def to_json(self) -> str:
        keep = {k: (v.tolist() if isinstance(v, np.ndarray) else v) for k, v in self.__dict__.items() if k not in ("terms", "fam")}
        return json.dumps({**keep, "terms": [t.state() for t in self.terms], "family": {"name": self.fam.name, "link": self.fam.link_name, "params": self.fam.params()}})

    @staticmethod
    def from_json(text: str) -> "GamModel":
        d = json.loads(text)
        params = {k: tuple(v) if isinstance(v, list) else v for k, v in d["family"]["params"].items()}
        fam = make_family(d["family"]["name"], d["family"]["link"] if d["family"]["name"] not in ("ocat",) else None, **params)
        arrays = ("beta", "vcov", "lam", "edf", "gram", "rhs")
        rest = {k: np.array(v) if k in arrays else v for k, v in d.items() if k not in ("terms", "family", "view")}
        return GamModel(terms=[restored(t) for t in d["terms"]], fam=fam, view=None if d["view"] is None else tuple(d["view"]), **rest)

    def artefact(self, n_points: int = 100, range_multiplier: float = 1.0) -> dict:
        """A scoring artefact: prediction matrix over parallel grids of every predictor, with a far point on either side."""
        grids = {}
        for t in self.terms:
            if t.kind == "re":
                grids[t.name] = np.array((t.levels * (n_points // max(len(t.levels), 1) + 3))[: n_points + 2], dtype=object)
                continue
            lo, hi = self.training["lo"][t.name], self.training["hi"][t.name]
            far = range_multiplier * (hi - lo)
            grids[t.name] = np.concatenate([[lo - far], np.linspace(lo, hi, n_points), [hi + far]])
        return {
            "predictors_info": {t.name: [self.span(i).start, self.span(i).stop - 1] for i, t in enumerate(self.terms)},
            "lp_matrix": self.design(grids), "coefficients": self.beta, "cov_matrix": self.vcov,
            "lp_feature_values": np.column_stack([np.ones(n_points + 2), *[np.asarray(g, dtype=object) if g.dtype == object else g for g in grids.values()]]),
            "predictors": self.names, "family": self.fam.name, "link": self.fam.link_name, "pc_map": {t.name: t.pc for t in self.terms if t.pc is not None},
        }


def predictions(model: GamModel, pdf: pd.DataFrame) -> np.ndarray:
    """Predictions for rows in memory, by the same kernels."""
    return model.fam.mean(NP, model.design({n: pdf[n].to_numpy() for n in model.names}) @ model.beta)
