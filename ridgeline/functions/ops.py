"""The arithmetic that formulas are written in: `NP` works on numpy arrays, `SP` on Spark columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


class NP:
    exp, log, log1p, sqrt, abs, floor = np.exp, np.log, np.log1p, np.sqrt, np.abs, np.floor
    sinh, cosh, tanh, asinh, atan = np.sinh, np.cosh, np.tanh, np.arcsinh, np.arctan
    least, greatest = staticmethod(np.minimum), staticmethod(np.maximum)
    power = staticmethod(np.power)

    @staticmethod
    def where(c, a, b):
        return np.where(c, a, b)

    @staticmethod
    def lit(x):
        return np.float64(x)


class SP:
    exp, log, log1p, sqrt, abs = F.exp, F.log, F.log1p, F.sqrt, F.abs
    sinh, cosh, tanh, asinh, atan = F.sinh, F.cosh, F.tanh, F.asinh, F.atan

    @staticmethod
    def floor(a):
        return F.floor(a).cast("double")

    @staticmethod
    def _c(x):
        return F.lit(float(x)) if isinstance(x, (int, float, np.floating)) else x

    @classmethod
    def least(cls, a, b):
        return F.least(cls._c(a), cls._c(b))

    @classmethod
    def greatest(cls, a, b):
        return F.greatest(cls._c(a), cls._c(b))

    @classmethod
    def power(cls, a, b):
        return F.pow(cls._c(a), cls._c(b))

    @classmethod
    def where(cls, c, a, b):
        return F.when(c, cls._c(a)).otherwise(cls._c(b))

    @staticmethod
    def lit(x):
        return F.lit(float(x))


def safe(o, c, a, f, other):
    """f(a) where c holds and `other` elsewhere; f never sees an a outside c."""
    return o.where(c, f(o.where(c, a, o.lit(1.0))), other)
