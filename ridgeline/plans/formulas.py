"""Queries over per-row formulas: links, variances, deviances, working pairs and densities, each with its SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import families as fm
from ..functions.links import ETA_LEAST, ETA_MAX, LINKS
from ..functions.ops import SP
from ..operators.diagnostics import pinball

KEY = ["l_orderkey", "l_linenumber"]
DIGITS = 6


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def rounded(df: DataFrame, values: dict[str, Column], keys: list[str] = KEY) -> DataFrame:
    return df.select(*keys, *[F.round(v, DIGITS).alias(k) for k, v in values.items()])


def sql_of(values: dict[str, str], table: str = "lineitem", keys: list[str] = KEY) -> str:
    return f"SELECT {', '.join(keys)}, {', '.join(f'round({v}, {DIGITS}) AS {k}' for k, v in values.items())} FROM {table}"


# Columns need a session, so they are made when a query is.
# Inputs: a linear predictor, positive and unit-interval means, and responses, all from one row of lineitem.
ETA, ETA_SQL = lambda: (F.col("l_quantity") - 25.5) / 5.0, "((l_quantity - 25.5) / 5.0)"
MU, MU_SQL = lambda: F.col("l_extendedprice") / 5000.0 + 0.1, "(l_extendedprice / 5000.0 + 0.1)"
UNIT, UNIT_SQL = lambda: F.col("l_tax") * 10.0 + 0.05, "(l_tax * 10.0 + 0.05)"
Y, Y_SQL = lambda: F.col("l_quantity") / 4.0, "(l_quantity / 4.0)"
COUNT, COUNT_SQL = lambda: (F.col("l_linenumber") - 1).cast("double"), "CAST(l_linenumber - 1 AS DOUBLE)"
SHARE, SHARE_SQL = lambda: F.least(F.col("l_discount") * 10.0, F.lit(1.0)), "least(l_discount * 10.0, 1.0)"


def links_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = {}
    for name, mu in (("identity", MU()), ("log", MU()), ("logit", UNIT()), ("inverse", MU())):
        link = LINKS[name]
        second, third, fourth = link.derivatives(SP, mu)
        out |= {f"{name}_link": link.link(SP, mu), f"{name}_inverse": link.inverse(SP, ETA()), f"{name}_slope": link.slope(SP, ETA()), f"{name}_g2": second, f"{name}_g3": third, f"{name}_g4": fourth}
    return rounded(lines(spark, sf_dir), out)


_E = f"least(greatest({ETA_SQL}, -{ETA_MAX}), {ETA_MAX})"
_R = f"(CASE WHEN abs({ETA_SQL}) >= {ETA_LEAST} THEN {ETA_SQL} WHEN {ETA_SQL} < 0 THEN -{ETA_LEAST} ELSE {ETA_LEAST} END)"
_P = f"(1 / (1 + exp(-{_E})))"
LINK_SQL = sql_of({
    "identity_link": MU_SQL, "identity_inverse": ETA_SQL, "identity_slope": "1.0::DOUBLE", "identity_g2": "0.0::DOUBLE", "identity_g3": "0.0::DOUBLE", "identity_g4": "0.0::DOUBLE",
    "log_link": f"ln({MU_SQL})", "log_inverse": f"exp({_E})", "log_slope": f"exp({_E})", "log_g2": f"-1 / pow({MU_SQL}, 2)", "log_g3": f"2 / pow({MU_SQL}, 3)", "log_g4": f"-6 / pow({MU_SQL}, 4)",
    "logit_link": f"ln({UNIT_SQL} / (1 - {UNIT_SQL}))", "logit_inverse": _P, "logit_slope": f"{_P} * (1 - {_P})",
    "logit_g2": f"1 / pow(1 - {UNIT_SQL}, 2) - 1 / pow({UNIT_SQL}, 2)", "logit_g3": f"2 / pow(1 - {UNIT_SQL}, 3) + 2 / pow({UNIT_SQL}, 3)", "logit_g4": f"6 / pow(1 - {UNIT_SQL}, 4) - 6 / pow({UNIT_SQL}, 4)",
    "inverse_link": f"1 / {MU_SQL}", "inverse_inverse": f"1 / {_R}", "inverse_slope": f"-1 / pow({_R}, 2)", "inverse_g2": f"2 / pow({MU_SQL}, 3)", "inverse_g3": f"-6 / pow({MU_SQL}, 4)", "inverse_g4": f"24 / pow({MU_SQL}, 5)",
})

#: Family, mean and response by name, with SQL for the variance and its slope at m, and the deviance of y at m.
CASES: dict[str, tuple[fm.Family, Callable[[], Column], str, Callable[[], Column], str, str, str, str]] = {
    "gaussian": (fm.Gaussian(), MU, MU_SQL, Y, Y_SQL, "1.0", "0.0", "pow(y - m, 2)"),
    "binomial": (fm.Binomial(), UNIT, UNIT_SQL, SHARE, SHARE_SQL, "m * (1 - m)", "1 - 2 * m", "2 * (CASE WHEN y > 0 THEN y * ln(y / m) ELSE 0 END + CASE WHEN y < 1 THEN (1 - y) * ln((1 - y) / (1 - m)) ELSE 0 END)"),
    "quasibinomial": (fm.QuasiBinomial(), UNIT, UNIT_SQL, SHARE, SHARE_SQL, "m * (1 - m)", "1 - 2 * m", "2 * (CASE WHEN y > 0 THEN y * ln(y / m) ELSE 0 END + CASE WHEN y < 1 THEN (1 - y) * ln((1 - y) / (1 - m)) ELSE 0 END)"),
    "poisson": (fm.Poisson(), MU, MU_SQL, COUNT, COUNT_SQL, "m", "1.0", "CASE WHEN y > 0 THEN 2 * (y * ln(y / m) - (y - m)) ELSE 2 * m END"),
    "quasipoisson": (fm.QuasiPoisson(), MU, MU_SQL, COUNT, COUNT_SQL, "m", "1.0", "CASE WHEN y > 0 THEN 2 * (y * ln(y / m) - (y - m)) ELSE 2 * m END"),
    "gamma": (fm.Gamma(), MU, MU_SQL, Y, Y_SQL, "m * m", "2 * m", "2 * ((y - m) / m - ln(y / m))"),
    "inverse_gaussian": (fm.InverseGaussian(), MU, MU_SQL, Y, Y_SQL, "pow(m, 3)", "3 * m * m", "pow(y - m, 2) / (m * m * y)"),
    "tweedie": (fm.Tweedie(p=1.4), MU, MU_SQL, COUNT, COUNT_SQL, "pow(m, 1.4)", "1.4 * pow(m, 0.4)",
                "2 * (CASE WHEN y > 0 THEN pow(y, 0.6) / (-0.4 * 0.6) ELSE 0 END - y * pow(m, -0.4) / -0.4 + pow(m, 0.6) / 0.6)"),
    "negbin": (fm.NegBin(theta=3.0), MU, MU_SQL, COUNT, COUNT_SQL, "m + m * m / 3", "1 + 2 * m / 3", "CASE WHEN y > 0 THEN 2 * (y * ln(y / m) - (y + 3) * ln((y + 3) / (m + 3))) ELSE 6 * ln((m + 3) / 3) END"),
    "t": (fm.StudentT(nu=4.0, sigma2=2.0), MU, MU_SQL, Y, Y_SQL, "2.0", "0.0", "5 * ln(1 + pow(y - m, 2) / 8)"),
}

_LINK_SLOPES = {"identity": ("e", "1.0", "0.0"), "log": ("exp(least(e, 20))", "exp(least(e, 20))", "-1 / (m * m)"), "logit": ("1 / (1 + exp(-e))", "m * (1 - m)", "1 / pow(1 - m, 2) - 1 / (m * m)")}


def variance_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = {}
    for name, (fam, mu, *_) in CASES.items():
        out |= {f"{name}_v": fam.variance(SP, mu()), f"{name}_dv": fam.variance_slopes(SP, mu())[0]}
    return rounded(lines(spark, sf_dir), out)


def _at(expr: str, m: str, y: str) -> str:
    import re

    return re.sub(r"\b[my]\b", lambda g: m if g[0] == "m" else y, expr)


VARIANCE_SQL = sql_of({k: v for name, c in CASES.items() for k, v in ((f"{name}_v", f"CAST({_at(c[5], c[2], c[4])} AS DOUBLE)"), (f"{name}_dv", f"CAST({_at(c[6], c[2], c[4])} AS DOUBLE)")) if name != "t" or k.endswith("_v")} | {"t_dv": "0.0::DOUBLE"})


def _deviance(name: str):
    fam, mu, _, y, *_ = CASES[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(lines(spark, sf_dir), {"deviance": fam.deviance(SP, y(), mu())})

    return query


def _working(name: str):
    fam, _, _, y, *_ = CASES[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        w, g = fam.working(SP, y(), ETA(), newton=False)
        n, _ = fam.working(SP, y(), ETA(), newton=True)
        return rounded(lines(spark, sf_dir), {"fisher_w": w, "score": g, "newton_w": n, "z": ETA() + g / w})

    return query


def _working_sql(name: str) -> str:
    fam, _, _, _, y, v, dv, _ = CASES[name]
    inv, slope, g2 = _LINK_SLOPES[fam.link_name]
    return f"""WITH a AS (SELECT *, {ETA_SQL} AS e, {y} AS y FROM lineitem), b AS (SELECT *, {inv} AS m FROM a),
        c AS (SELECT *, CAST({v} AS DOUBLE) AS v, CAST({dv} AS DOUBLE) AS dv, CAST({slope} AS DOUBLE) AS s, CAST({g2} AS DOUBLE) AS g2 FROM b),
        d AS (SELECT *, 1 + (y - m) * (dv / v + g2 * s) AS alpha, s * s / v AS w FROM c)
        SELECT l_orderkey, l_linenumber, round(greatest(w, 1e-10), 6) AS fisher_w, round((y - m) * s / v, 6) AS score,
               round(greatest(CASE WHEN alpha > 0 THEN w * alpha ELSE w END, 1e-10), 6) AS newton_w, round(e + (y - m) * s / v / greatest(w, 1e-10), 6) AS z FROM d"""


ELF = fm.Quantile(tau=0.8, sigma=0.7, co=0.5)
_SOFT = "(greatest(u, 0) + ln(1 + exp(-abs(u))))"
ELF_SQL = f"""WITH a AS (SELECT *, {Y_SQL} - {MU_SQL} AS r, ({Y_SQL} - {MU_SQL}) / 0.5 AS u FROM lineitem),
    b AS (SELECT *, CASE WHEN u >= 0 THEN 1 / (1 + exp(-abs(u))) ELSE exp(-abs(u)) / (1 + exp(-abs(u))) END AS p, exp(-abs(u)) / pow(1 + exp(-abs(u)), 2) AS q,
                 0.2 * 0.5 * ln(0.2) + 0.5 * 0.8 * ln(0.8) - 0.2 * r + 0.5 * {_SOFT} AS t FROM a)
    SELECT l_orderkey, l_linenumber, round(2 * t / 0.7, 6) AS d, round(-2 * (p - 0.2) / 0.7, 6) AS dmu, round(2 * q / 0.35, 6) AS dmu2,
           round(2 * q * (2 * p - 1) / (0.25 * 0.7), 6) AS dmu3, round(-2 * t / 0.7, 6) AS dtheta FROM b"""


def elf_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lines(spark, sf_dir), dict(zip(("d", "dmu", "dmu2", "dmu3", "dtheta"), ELF.parts(SP, Y(), MU()))))


T5 = fm.StudentT(nu=5.0, sigma2=1.5)


def t_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lines(spark, sf_dir), {k: T5.weights(SP, Y() - MU(), k) for k in ("em", "newton", "fisher")})


OCAT = fm.OrderedCategorical(theta=(0.2, -0.3))


def ocat_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("l_linenumber") % 4 + 1
    w, g = OCAT.working(SP, y.cast("double"), ETA())
    return rounded(lines(spark, sf_dir), {f"p{r}": OCAT.probability(SP, ETA(), r) for r in range(1, 5)} | {"deviance": OCAT.deviance(SP, y.cast("double"), ETA()), "w": w, "score": g})


def _ocat_sql() -> str:
    c1, c2 = -1 + math.exp(0.2), -1 + math.exp(0.2) + math.exp(-0.3)
    f = lambda c: f"(1 / (1 + exp(-({c!r} - e))))"
    cuts = [f(-1.0), f(c1), f(c2)]
    p = [cuts[0], f"{cuts[1]} - {cuts[0]}", f"{cuts[2]} - {cuts[1]}", f"1 - {cuts[2]}"]
    hi = "CASE y WHEN 1 THEN f1 WHEN 2 THEN f2 WHEN 3 THEN f3 ELSE 1 END"
    lo = "CASE y WHEN 1 THEN 0 WHEN 2 THEN f1 WHEN 3 THEN f2 ELSE f3 END"
    return f"""WITH a AS (SELECT *, {ETA_SQL} AS e, l_linenumber % 4 + 1 AS y FROM lineitem), b AS (SELECT *, {cuts[0]} AS f1, {cuts[1]} AS f2, {cuts[2]} AS f3 FROM a),
        c AS (SELECT *, {hi} AS hi, {lo} AS lo FROM b)
        SELECT l_orderkey, l_linenumber, {', '.join(f'round({x}, 6) AS p{i}' for i, x in enumerate(p, 1))}, round(-2 * ln(hi - lo), 6) AS deviance,
               round(greatest(hi * (1 - hi) + lo * (1 - lo), 1e-10), 6) AS w, round(hi + lo - 1, 6) AS score FROM c"""


def saturated_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saturated log likelihoods of counts by order priority's stand-in, the return flag."""
    from ..functions.special import lgamma

    y, t = COUNT(), 3.0
    ylogy = F.when(y > 0, y * F.log(y)).otherwise(0.0)
    pois = ylogy - y - lgamma(SP, y + 1.0)
    nb = lgamma(SP, y + t) - math.lgamma(t) - lgamma(SP, y + 1.0) + t * math.log(t) + ylogy - (y + t) * F.log(y + t)
    return lines(spark, sf_dir).groupBy("l_returnflag").agg(F.round(F.sum(pois), 3).alias("poisson_ll"), F.round(F.sum(nb), 3).alias("negbin_ll"))


SATURATED_SQL = f"""WITH a AS (SELECT l_returnflag, {COUNT_SQL} AS y FROM lineitem), b AS (SELECT *, CASE WHEN y > 0 THEN y * ln(y) ELSE 0 END AS yl FROM a)
    SELECT l_returnflag, round(sum(yl - y - lgamma(y + 1)), 3) AS poisson_ll,
           round(sum(lgamma(y + 3) - lgamma(3) - lgamma(y + 1) + 3 * ln(3) + yl - (y + 3) * ln(y + 3)), 3) AS negbin_ll FROM b GROUP BY l_returnflag"""


def pinball_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("l_returnflag").agg(*[F.round(F.avg(pinball(Y(), MU(), t)), 6).alias(f"loss_{int(t * 100)}") for t in (0.1, 0.5, 0.9)])


PINBALL_SQL = "SELECT l_returnflag, " + ", ".join(f"round(avg(greatest({t} * ({Y_SQL} - {MU_SQL}), ({t} - 1) * ({Y_SQL} - {MU_SQL}))), 6) AS loss_{int(t * 100)}" for t in (0.1, 0.5, 0.9)) + " FROM lineitem GROUP BY l_returnflag"

QUERIES = {"links_all": links_all, "variance_all": variance_all, "elf_parts": elf_parts, "t_weights": t_weights, "ocat_proba": ocat_proba, "saturated_likelihood": saturated_likelihood, "pinball_loss": pinball_loss}
ORACLES = {
    "links_all": LINK_SQL, "variance_all": VARIANCE_SQL, "elf_parts": ELF_SQL, "ocat_proba": _ocat_sql(), "saturated_likelihood": SATURATED_SQL, "pinball_loss": PINBALL_SQL,
    "t_weights": sql_of({"em": f"6 / (7.5 + pow({Y_SQL} - {MU_SQL}, 2))", "newton": f"6 * (7.5 - pow({Y_SQL} - {MU_SQL}, 2)) / pow(7.5 + pow({Y_SQL} - {MU_SQL}, 2), 2)", "fisher": "6 / (8 * 1.5)::DOUBLE"}),
}
for _name, _c in CASES.items():
    QUERIES[f"deviance_{_name}"] = _deviance(_name)
    ORACLES[f"deviance_{_name}"] = sql_of({"deviance": _at(_c[7], _c[2], _c[4])})
    if _c[0].link_name in _LINK_SLOPES and _name != "t":
        QUERIES[f"working_pair_{_name}"] = _working(_name)
        ORACLES[f"working_pair_{_name}"] = _working_sql(_name)
