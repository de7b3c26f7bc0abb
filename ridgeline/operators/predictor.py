"""A fitted model for serving: it scores DataFrames, refuses columns that have drifted, and can't be changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.ops import SP
from .model import GamModel


class Predictor:
    """A frozen view of a fitted model, of an estimator that holds one, or of a model's JSON."""

    __slots__ = ("model",)

    def __init__(self, fitted):
        model = GamModel.from_json(fitted) if isinstance(fitted, str) else fitted if isinstance(fitted, GamModel) else getattr(fitted, "model", None)
        if not isinstance(model, GamModel):
            raise TypeError(f"a fitted model is needed, not {type(fitted).__name__}")
        object.__setattr__(self, "model", model)

    def __setattr__(self, name, value):
        raise AttributeError("a predictor can't be changed")

    def __repr__(self) -> str:
        return f"Predictor(family={self.model.fam.name!r}, link={self.model.fam.link_name!r}, columns={self.columns})"

    @property
    def columns(self) -> list[str]:
        """What it reads, each once, in the terms' order."""
        return list(dict.fromkeys(self.model.terms[i].name for i in self.model.active))

    def __getitem__(self, names) -> "Predictor":
        return Predictor(self.model[names])

    def __getattr__(self, name):
        if name.startswith("__") or name not in ("intercept", "coef", "smoothing", "vcov", "edf", "edf_by_term", "edf_total", "beta", "lam", "scale"):
            raise AttributeError(name)
        return getattr(self.model, name)

    def checked(self, df: DataFrame) -> DataFrame:
        """df itself; columns that are missing, or aren't numbers where numbers were fitted, are named and refused."""
        kinds = {f.name: f.dataType for f in df.schema}
        if missing := [c for c in self.columns if c not in kinds]:
            raise ValueError(f"columns not found: {', '.join(missing)}")
        wrong = [t.name for i in self.model.active if (t := self.model.terms[i]).kind != "re" and not isinstance(kinds[t.name], NumericType)]
        if wrong:
            raise ValueError(f"columns aren't numbers: {', '.join(dict.fromkeys(wrong))}")
        return df

    def transform(self, df: DataFrame, kind: str = "response", column: str = "prediction") -> DataFrame:
        return self.model.transform(self.checked(df), kind, column)

    def transform_terms(self, df: DataFrame, prefix: str = "f_") -> DataFrame:
        return self.model.transform_terms(self.checked(df), prefix)

    def transform_ci(self, df: DataFrame, **how) -> DataFrame:
        return self.model.transform_ci(self.checked(df), **how)

    def change(self, start: DataFrame, end: DataFrame, on: str | None = None, broadcast: str = "none", level: float | None = None) -> DataFrame:
        return self.model.change(self.checked(start), self.checked(end), on, broadcast, level)

    def check_against(self, other, df: DataFrame, rtol: float = 1e-10, atol: float = 1e-12) -> None:
        """Raises AssertionError, with the largest gaps, where predictions over df differ by more than atol + rtol |theirs|."""
        theirs = Predictor(other).model
        a, b = self.model.fam.mean(SP, self.model.eta()), theirs.fam.mean(SP, theirs.eta())
        both = Predictor(theirs).checked(self.checked(df)).select(a.alias("a"), b.alias("b"))
        gap = F.abs(F.col("a") - F.col("b"))
        off = (F.isnull("a") != F.isnull("b")) | (F.isnan("a") != F.isnan("b")) | (gap > F.lit(atol) + F.lit(rtol) * F.abs("b"))
        r = both.agg(F.sum(F.coalesce(off, F.lit(False)).cast("long")).alias("n"), F.max(gap).alias("gap"), F.max(gap / F.when(F.col("b") == 0, 1.0).otherwise(F.abs("b"))).alias("rel")).first()
        if r["n"]:
            raise AssertionError(f"{r['n']} predictions differ: by {r['gap']} at most, relatively {r['rel']} (rtol={rtol}, atol={atol})")
