"""Queries that prepare, bin or fit, with SQL that reaches the same numbers by other ways where it can."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.families import family
from ..operators import binning
from ..operators.diagnostics import coverage_shifts, k_index
from ..operators.fit import TARGET, WEIGHT, Design, Options, Statistics, constrain, distinct_values, fit_gam, prepared, profile, reml_at
from ..operators.mixed import fit_mixed
from ..operators.quantile import LOG_ABS_NORMAL, fit_location_scale, fit_quantile
from ..operators.rows import SparkRows
from ..operators.terms import BSpline, Cubic, Linear, RandomEffect, ThinPlate
from .formulas import lines

LAMBDA = 2.0


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _terms_frame(spark: SparkSession, model, **more) -> DataFrame:
    out = model.summary_frame(spark)
    for k, v in {"family": model.fam.name, "edf_total": model.edf_total, "scale": float(model.scale), "deviance": float(model.deviance), **more}.items():
        out = out.withColumn(k, F.lit(v))
    return out


# -- knots and bases ------------------------------------------------------------------------------------------------------


def cr_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile knots of distinct values for several columns and k, as a fit places them."""
    label = {"l_extendedprice": "price", "l_quantity": "quantity", "l_discount": "discount"}
    terms = [Cubic("l_extendedprice", 10), Cubic("l_quantity", 6), Cubic("l_discount", 5)]
    data = prepared(lines(spark, sf_dir), "l_tax", terms, None, "fail")
    p = profile(data, terms)
    distinct_values(SparkRows(data, data.columns), data, terms, p, "quantile")
    rows = [(label[t.name], i, float(v)) for t in terms for i, v in enumerate(p.knots[t.name])]
    return spark.createDataFrame(rows, "name string, i int, knot double").select("name", "i", F.round("knot", 6).alias("knot"))


CR_KNOTS_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS name, {i} AS i, round(quantile_cont(DISTINCT {c}, {i} / {k - 1}.0), 6) AS knot FROM lineitem" for n, c, k in (("price", "l_extendedprice", 10), ("quantity", "l_quantity", 6), ("discount", "l_discount", 5)) for i in range(k)
)

QUANTITY_KNOTS = np.linspace(5.0, 45.0, 5)  # inside 1..50, so that both ends are extrapolated


def _basis_frame(df: DataFrame, term, size: int, x) -> DataFrame:
    term.z = np.eye(size)
    return df.select("l_orderkey", "l_linenumber", *[F.round(term.column(x, np.eye(size)[j]), 6).alias(f"b{j}") for j in range(size)])


def cr_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _basis_frame(lines(spark, sf_dir), Cubic("l_quantity", 5, knots=QUANTITY_KNOTS), 5, F.col("l_quantity"))


def _natural(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For SQL: second derivatives at the knots of the cubics that are 1 at one knot and 0 at the others, and the integrals of
    their products, from the conditions on each interval's polynomial instead of the terms' band matrices."""
    k = len(t)
    rows, sides = [], []

    def add(side, **parts):
        row = np.zeros(4 * (k - 1))
        for piece, (interval, u) in parts.items():
            d, sign = int(piece[1]), -1.0 if piece[0] == "m" else 1.0
            row[4 * interval : 4 * interval + 4] += sign * np.array([0.0 if q < d else np.prod(np.arange(q, q - d, -1.0)) * u ** (q - d) for q in range(4)])
        rows.append(row)
        sides.append(side)

    one, none = np.eye(k), np.zeros(k)
    for i in range(k - 1):
        add(one[i], p0=(i, 0.0))
        add(one[i + 1], p0=(i, t[i + 1] - t[i]))
        for d in (1, 2):
            if i < k - 2:
                add(none, **{f"p{d}": (i, t[i + 1] - t[i]), f"m{d}": (i + 1, 0.0)})
    add(none, p2=(0, 0.0))
    add(none, p2=(k - 2, t[-1] - t[-2]))
    c = np.linalg.solve(np.array(rows), np.array(sides))
    second = np.vstack([2 * c[2::4], np.zeros((1, k))])
    s = np.zeros((k, k))
    for i in range(k - 1):
        a, b = second[i], second[i + 1]
        s += (t[i + 1] - t[i]) / 6 * (2 * np.outer(a, a) + np.outer(a, b) + np.outer(b, a) + 2 * np.outer(b, b))
    return second, s


def _cr_basis_sql() -> str:
    """The second-derivative form: values and curvatures at both ends of the interval, and tangents outside."""
    t = QUANTITY_KNOTS
    f, h, k = _natural(t)[0], t[1] - t[0], len(t)
    cols = []
    for j in range(k):
        e = np.eye(k)[j]
        slope_lo = (e[1] - e[0]) / h - h / 6 * (2 * f[0, j] + f[1, j])
        slope_hi = (e[-1] - e[-2]) / h + h / 6 * (f[-2, j] + 2 * f[-1, j])
        case = [f"WHEN x < {t[0]!r} THEN {e[0]!r} + (x - {t[0]!r}) * ({float(slope_lo)!r})"]
        for i in range(k - 1):
            a, b = f"(({t[i + 1]!r} - x) / {h!r})", f"((x - {t[i]!r}) / {h!r})"
            case.append(f"WHEN x <= {t[i + 1]!r} THEN {a} * {e[i]!r} + {b} * {e[i + 1]!r} + {h * h / 6!r} * ((pow({a}, 3) - {a}) * ({float(f[i, j])!r}) + (pow({b}, 3) - {b}) * ({float(f[i + 1, j])!r}))")
        case.append(f"ELSE {e[-1]!r} + (x - {t[-1]!r}) * ({float(slope_hi)!r})")
        cols.append(f"round(CASE {' '.join(case)} END, 6) AS b{j}")
    sql = ", ".join(cols).replace("np.float64(", "(")
    return f"SELECT l_orderkey, l_linenumber, {sql} FROM (SELECT *, l_quantity AS x FROM lineitem)"


def bs_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _basis_frame(lines(spark, sf_dir), BSpline("l_quantity", 7, lo=1.0, hi=50.0), 7, F.col("l_quantity"))


def _bs_basis_sql() -> str:
    # Seven splines on four intervals over 1..50, a thousandth of the range wider at each end, and three knots beyond.
    h = 49 * 1.002 / 4
    t, knots = 1 - 0.049 - 3 * h, range(11)
    piece = {0: "pow(1 - u, 3)", 1: "3 * pow(u, 3) - 6 * u * u + 4", 2: "-3 * pow(u, 3) + 3 * u * u + 3 * u + 1", 3: "pow(u, 3)"}
    cols = [f"round(CASE {' '.join(f'WHEN j - 3 + {i} = {c} THEN ({p}) / 6' for i, p in piece.items())} ELSE 0 END, 6) AS b{c}" for c in range(7)]
    return f"""WITH a AS (SELECT *, greatest(3, least({len(knots) - 5}, CAST(floor((l_quantity - ({float(t)!r})) / {float(h)!r}) AS INTEGER))) AS j FROM lineitem),
        b AS (SELECT *, (l_quantity - ({float(t)!r} + j * {float(h)!r})) / {float(h)!r} AS u FROM a) SELECT l_orderkey, l_linenumber, {', '.join(cols)} FROM b"""


# -- Gram matrices and fits -----------------------------------------------------------------------------------------------


def gram_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X'X and X'y of [1, quantity, discount, tax] as rows, by the statistics of a fit. Squares of hundredths end in the fourth decimal,
    so a third would be a matter of ties."""
    terms = [Linear("l_quantity"), Linear("l_discount"), Linear("l_tax")]
    data = prepared(lines(spark, sf_dir).withColumn("y", F.col("l_extendedprice") / 1000.0), "y", terms, None, "fail")
    rows = SparkRows(data, [TARGET, WEIGHT, *[t.name for t in terms]])
    constrain(rows, terms, 1)
    s = Statistics(rows, Design(terms), family("gaussian")).at(None)
    names, full = ["one", "quantity", "discount", "tax", "y"], np.block([[s["g"], s["r"][:, None]], [s["r"][None, :], np.array([[s["zz"]]])]])
    made = [(a, b, float(full[i, j])) for i, a in enumerate(names) for j, b in enumerate(names[: i + 1])]
    return spark.createDataFrame(made, "a string, b string, v double").select("a", "b", F.round("v", 2).alias("v"))


def _gram_sql() -> str:
    x = {"one": "1.0", "quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax", "y": "l_extendedprice / 1000.0"}
    n = list(x)
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum(({x[a]})::DOUBLE * ({x[b]})::DOUBLE), 2) AS v FROM lineitem" for i, a in enumerate(n) for b in n[: i + 1])


def gam_fixed_lambda_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted price by quantity: one cubic smooth on even knots at a fixed smoothing parameter."""
    df = lines(spark, sf_dir)
    m = fit_gam(df, "l_extendedprice", [Cubic("l_quantity", 4)], opt=Options(lam=[LAMBDA], knots="uniform", local_rows=0))
    return m.transform(df.select("l_quantity").distinct()).select("l_quantity", F.round("prediction", 3).alias("prediction"))


def gam_discrete_fixed_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted quantity by price, in cells: one cubic smooth on even knots at a fixed smoothing parameter, from sums by cell alone."""
    df = lines(spark, sf_dir)
    m = fit_gam(df, "l_quantity", [Cubic("l_extendedprice", 4)], opt=Options(lam=[LAMBDA], knots="uniform", discrete=True, local_rows=0))
    lo, hi = m.training["lo"]["l_extendedprice"], m.training["hi"]["l_extendedprice"]
    cells = df.select(binning.bin_index(F.col("l_extendedprice"), lo, hi).alias("bin")).distinct()
    centres = cells.select("bin", binning.bin_centre(F.col("bin"), lo, hi).alias("l_extendedprice"))
    return m.transform(centres).select("bin", F.round("prediction", 4).alias("prediction"))


#: Cells, and the place of a cell between four even knots.
DISCRETE_ROWS = """c AS (SELECT l_quantity AS y, CAST(round((l_extendedprice - lo) / ((hi - lo) / 1000)) AS INTEGER) AS bin FROM lineitem, r),
        v AS (SELECT bin, y, bin / 1000.0::DOUBLE * 3 AS v FROM c)"""


def _fixed_sql(x: str = "l_quantity", key: str = "l_quantity", digits: int = 3, rows: str = "v AS (SELECT l_quantity, l_extendedprice AS y, (l_quantity - lo) / ((hi - lo) / 3.0) AS v FROM lineitem, r)") -> str:
    """The same fit by elimination: cubics at the knots sum to 1, so the intercept and the constraint fold into the values there."""
    k = 4
    f, s = _natural(np.arange(4.0))  # on unit spacing; spacing h scales curvature by 1/h^2 and the penalty by 1/h^3
    basis = []
    for j in range(k):
        e = np.eye(k)[j]
        case = []
        for i in range(k - 1):
            a, b = f"({i + 1} - v)", f"(v - {i})"
            case.append(f"WHEN v <= {i + 1} THEN {a} * {float(e[i])} + {b} * {float(e[i + 1])} + ((pow({a}, 3) - {a}) * ({float(f[i, j])!r}) + (pow({b}, 3) - {b}) * ({float(f[i + 1, j])!r})) / 6")
        basis.append(f"CASE {' '.join(case)} END AS b{j}")
    g = [f"sum(b{i} * b{j}) + {LAMBDA} * max(nx) * max(nx) / {float(np.abs(s).sum(1).max())!r} * ({float(s[i, j])!r}) AS a{i}{j}" for i in range(k) for j in range(k)]
    sql = f"""WITH r AS (SELECT min({x}) AS lo, max({x}) AS hi FROM lineitem), {rows},
        b0 AS (SELECT {key}, y, {', '.join(basis)} FROM v), b AS (SELECT *, abs(b0) + abs(b1) + abs(b2) + abs(b3) AS nx FROM b0),
        e0 AS (SELECT {', '.join(g)}, {', '.join(f'sum(b{i} * y) AS r{i}' for i in range(k))} FROM b)"""
    for p in range(k):  # Gauss-Jordan
        cols = []
        for i in range(k):
            for j in range(k):
                cols.append(f"a{i}{j} / a{p}{p} AS a{i}{j}" if i == p else f"a{i}{j} - a{i}{p} * a{p}{j} / a{p}{p} AS a{i}{j}")
            cols.append(f"r{i} / a{p}{p} AS r{i}" if i == p else f"r{i} - a{i}{p} * r{p} / a{p}{p} AS r{i}")
        sql += f", e{p + 1} AS (SELECT {', '.join(cols)} FROM e{p})"
    return sql + f" SELECT DISTINCT {key}, round(b0 * r0 + b1 * r1 + b2 * r2 + b3 * r3, {digits}) AS prediction FROM b, e4"


#: Response, its SQL, starting mean, and for SQL the mean, curvature and score at the linear predictor e.
_LAWS = {
    "poisson": (lambda: LINE(), "l_linenumber::DOUBLE", "ln(avg(y))", "exp(e)", "m", "y - m"),
    "binomial": (lambda: RETURNED(), "(l_returnflag = 'R')::INT::DOUBLE", "ln(avg(y) / (1 - avg(y)))", "1 / (1 + exp(-e))", "m * (1 - m)", "y - m"),
    "gamma": (lambda: F.col("l_extendedprice") / 1000.0, "l_extendedprice / 1000.0", "ln(avg(y))", "exp(e)", "1.0", "(y - m) / m"),
    "inverse.gaussian": (lambda: F.col("l_extendedprice") / 1000.0, "l_extendedprice / 1000.0", "ln(avg(y))", "exp(e)", "1 / m", "(y - m) / (m * m)"),
    "negbin": (lambda: LINE(), "l_linenumber::DOUBLE", "ln(avg(y))", "exp(e)", "m / (1 + m / 2)", "(y - m) / (1 + m / 2)"),
    "tweedie": (lambda: F.col("l_extendedprice") / 1000.0, "l_extendedprice / 1000.0", "ln(avg(y))", "exp(e)", "sqrt(m)", "(y - m) / sqrt(m)"),
}


def _fixed(law: str, discrete: bool = False):
    """One cubic smooth on even knots at a fixed smoothing parameter, over rows in Spark: of quantity, or of price in cells."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = "l_extendedprice" if discrete else "l_quantity"
        df = lines(spark, sf_dir).withColumn("y", (F.col("l_quantity") / 10.0) if discrete and law == "gamma" else _LAWS[law][0]())
        m = fit_gam(df, "y", [Cubic(x, 4)], family(law, "log" if law == "gamma" else None), opt=Options(lam=[LAMBDA], knots="uniform", discrete=discrete, local_rows=0), profile_shape=False)
        if not discrete:
            return m.transform(df.select(x).distinct(), "link").select(x, F.round("prediction", 5).alias("eta"))
        lo, hi = m.training["lo"][x], m.training["hi"][x]
        cells = df.select(binning.bin_index(F.col(x), lo, hi).alias("bin")).distinct()
        return m.transform(cells.select("bin", binning.bin_centre(F.col("bin"), lo, hi).alias(x)), "link").select("bin", F.round("prediction", 5).alias("eta"))

    return query


def _fixed_law_sql(law: str, discrete: bool = False, rounds: int = 14) -> str:
    """The same by Newton or scoring steps over sums by place, each solved by elimination. Places hold n, the sum of y, and no more,
    as score and curvature ask for nothing else."""
    _, y, start, mean, weight, score = _LAWS[law]
    if discrete and law == "gamma":
        y = "l_quantity / 10.0"
    k, x = 4, "l_extendedprice" if discrete else "l_quantity"
    f, s = _natural(np.arange(4.0))
    basis = []
    for j in range(k):
        e = np.eye(k)[j]
        case = []
        for i in range(k - 1):
            a, b = f"({i + 1} - v)", f"(v - {i})"
            case.append(f"WHEN v <= {i + 1} THEN {a} * {float(e[i])} + {b} * {float(e[i + 1])} + ((pow({a}, 3) - {a}) * ({float(f[i, j])!r}) + (pow({b}, 3) - {b}) * ({float(f[i + 1, j])!r})) / 6")
        basis.append(f"CASE {' '.join(case)} END AS b{j}")
    place = "CAST(round((l_extendedprice - lo) / ((hi - lo) / 1000)) AS INTEGER) AS bin" if discrete else "l_quantity"
    key, v = ("bin", "bin / 1000.0::DOUBLE * 3") if discrete else ("l_quantity", "(l_quantity - any_value(lo)) / ((any_value(hi) - any_value(lo)) / 3.0)")
    sql = f"""WITH r AS (SELECT min({x}) AS lo, max({x}) AS hi FROM lineitem), c AS (SELECT {place}, {y} AS y, lo, hi FROM lineitem, r),
        v AS (SELECT {key}, {v} AS v, count(*)::DOUBLE AS n, sum(y) AS sy FROM c GROUP BY {key}),
        b0 AS (SELECT {key}, n, sy, {', '.join(basis)} FROM v), b AS MATERIALIZED (SELECT *, sy / n AS y, abs(b0) + abs(b1) + abs(b2) + abs(b3) AS nx FROM b0),
        s0 AS (SELECT {start.replace('avg(y)', '(sum(sy) / sum(n))')} AS r0, r0 AS r1, r0 AS r2, r0 AS r3 FROM b)"""
    for t in range(rounds):
        g = [f"sum(n * w * b{i} * b{j}) + {LAMBDA} * max(nx) * max(nx) / {float(np.abs(s).sum(1).max())!r} * ({float(s[i, j])!r}) AS a{i}{j}" for i in range(k) for j in range(k)]
        sql += f""", m{t} AS (SELECT b.*, b0 * r0 + b1 * r1 + b2 * r2 + b3 * r3 AS e, {mean} AS m, {weight} AS w, {score} AS g FROM b, s{t}),
            e{t}x0 AS MATERIALIZED (SELECT {', '.join(g)}, {', '.join(f'sum(n * b{i} * (w * e + g)) AS r{i}' for i in range(k))} FROM m{t})"""
        for p in range(k):  # Gauss-Jordan
            cols = []
            for i in range(k):
                for j in range(k):
                    cols.append(f"a{i}{j} / a{p}{p} AS a{i}{j}" if i == p else f"a{i}{j} - a{i}{p} * a{p}{j} / a{p}{p} AS a{i}{j}")
                cols.append(f"r{i} / a{p}{p} AS r{i}" if i == p else f"r{i} - a{i}{p} * r{p} / a{p}{p} AS r{i}")
            sql += f", e{t}x{p + 1} AS MATERIALIZED (SELECT {', '.join(cols)} FROM e{t}x{p})"
        sql += f", s{t + 1} AS MATERIALIZED (SELECT r0, r1, r2, r3 FROM e{t}x{k})"
    return sql + f" SELECT {key}, round(b0 * r0 + b1 * r1 + b2 * r2 + b3 * r3, 5) AS eta FROM b, s{rounds}"


def parametric_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fit_gam(lines(spark, sf_dir), "l_extendedprice", [Linear("l_quantity")], opt=Options(local_rows=0))
    return spark.createDataFrame([(float(m.beta[0]), float(m.beta[1]))], "intercept double, slope double").select(F.round("intercept", 4).alias("intercept"), F.round("slope", 4).alias("slope"))


PARAMETRIC_SQL = "SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem"


def re_shrinkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random intercepts of order priorities at a fixed smoothing parameter."""
    df = _table(spark, sf_dir, "orders")
    m = fit_gam(df, "o_totalprice", [RandomEffect("o_orderpriority")], opt=Options(lam=[50.0], local_rows=0))
    rows = [(lv, float(m.beta[0]), float(b)) for lv, b in zip(m.terms[0].levels, m.beta[1:])]
    return spark.createDataFrame(rows, "o_orderpriority string, intercept double, effect double").select("o_orderpriority", F.round("intercept", 3).alias("intercept"), F.round("effect", 3).alias("effect"))


RE_SQL = """WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1),
    b AS (SELECT sum(n * 50.0 / (n + 50.0) * m) / sum(n * 50.0 / (n + 50.0)) AS b0 FROM g)
    SELECT o_orderpriority, round(b0, 3) AS intercept, round(n * (m - b0) / (n + 50.0), 3) AS effect FROM g, b"""


def re_many_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price by quantity with a random intercept of every part, at a fixed smoothing parameter: levels stay a table."""
    m = fit_mixed(lines(spark, sf_dir), "l_extendedprice", "l_partkey", [Linear("l_quantity")], opt=Options(lam=[20.0]))
    return m.effects.select(F.col("level").alias("l_partkey"), F.round("effect", 3).alias("effect"), F.col("weight").cast("long").alias("n"), F.lit(round(float(m.fixed.beta[1]), 4)).alias("slope"))


RE_MANY_SQL = """WITH l AS (SELECT l_partkey, count(*)::DOUBLE AS n, sum(l_quantity)::DOUBLE AS sx, sum(l_extendedprice)::DOUBLE AS sy FROM lineitem GROUP BY 1),
    t AS (SELECT count(*)::DOUBLE AS n, sum(l_quantity)::DOUBLE AS sx, sum(l_quantity * l_quantity)::DOUBLE AS sxx, sum(l_extendedprice)::DOUBLE AS sy, sum(l_quantity * l_extendedprice)::DOUBLE AS sxy FROM lineitem),
    o AS (SELECT sum(n * n / (n + 20)) AS n, sum(n * sx / (n + 20)) AS sx, sum(sx * sx / (n + 20)) AS sxx, sum(n * sy / (n + 20)) AS sy, sum(sx * sy / (n + 20)) AS sxy FROM l),
    a AS (SELECT t.n - o.n AS n, t.sx - o.sx AS sx, t.sxx - o.sxx AS sxx, t.sy - o.sy AS sy, t.sxy - o.sxy AS sxy FROM t, o),
    b AS (SELECT (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS b0, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1 FROM a)
    SELECT l_partkey, round((sy - b0 * n - b1 * sx) / (n + 20), 3) AS effect, n::BIGINT AS n, round(b1, 4) AS slope FROM l, b"""

LAMBDAS = [10.0**e for e in range(-3, 7)]


def reml_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restricted likelihood score of one smooth over smoothing parameters, less its value at 1."""
    df = lines(spark, sf_dir).withColumn("y", F.col("l_extendedprice") / 1000.0)
    m = fit_gam(df, "y", [Cubic("l_quantity", 4)], opt=Options(lam=[LAMBDA], knots="uniform", local_rows=0))
    rows = [(v, float(reml_at(m, [v]) - reml_at(m, [1.0]))) for v in LAMBDAS]
    return spark.createDataFrame(rows, "lambda double, score double").select("lambda", F.round("score", 4).alias("score"))


def _reml_profile_sql() -> str:
    """By elimination at each smoothing parameter: pivots give the determinant, and what isn't explained the scale. Determinants of
    the change of basis and of the penalty itself are the same for all, and leave the difference."""
    k = 4
    f, s = _natural(np.arange(4.0))
    basis = []
    for j in range(k):
        e = np.eye(k)[j]
        case = [f"WHEN v <= {i + 1} THEN ({i + 1} - v) * {float(e[i])} + (v - {i}) * {float(e[i + 1])} + ((pow({i + 1} - v, 3) - ({i + 1} - v)) * ({float(f[i, j])!r}) + (pow(v - {i}, 3) - (v - {i})) * ({float(f[i + 1, j])!r})) / 6" for i in range(k - 1)]
        basis.append(f"CASE {' '.join(case)} END AS b{j}")
    size = float(np.abs(s).sum(1).max())
    g = [f"sum(b{i} * b{j}) AS g{i}{j}" for i in range(k) for j in range(k)]
    sql = f"""WITH r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), v AS (SELECT (l_quantity - lo) / ((hi - lo) / 3.0) AS v, l_extendedprice / 1000.0 AS y FROM lineitem, r),
        b AS (SELECT y, {', '.join(basis)} FROM v), t AS (SELECT count(*)::DOUBLE AS n, sum(y * y) AS yy, max(abs(b0) + abs(b1) + abs(b2) + abs(b3)) AS nx, {', '.join(g)}, {', '.join(f'sum(b{i} * y) AS q{i}' for i in range(k))} FROM b),
        l AS (SELECT unnest([{', '.join(repr(v) for v in LAMBDAS)}]::DOUBLE[]) AS lam),
        e0 AS (SELECT lam, n, yy, 0.0::DOUBLE AS ld, {', '.join(f'g{i}{j} + lam * nx * nx / {size!r} * ({float(s[i, j])!r}) AS a{i}{j}' for i in range(k) for j in range(k))}, {', '.join(f'q{i} AS r{i}, q{i}' for i in range(k))} FROM t, l)"""
    for p in range(k):
        cols = []
        for i in range(k):
            for j in range(k):
                cols.append(f"a{i}{j} / a{p}{p} AS a{i}{j}" if i == p else f"a{i}{j} - a{i}{p} * a{p}{j} / a{p}{p} AS a{i}{j}")
            cols.append(f"r{i} / a{p}{p} AS r{i}" if i == p else f"r{i} - a{i}{p} * r{p} / a{p}{p} AS r{i}")
        sql += f", e{p + 1} AS (SELECT lam, n, yy, ld + ln(a{p}{p}) AS ld, {', '.join(f'q{i}' for i in range(k))}, {', '.join(cols)} FROM e{p})"
    sql += ", z AS (SELECT lam, (n - 2) / 2 * ln(yy - q0 * r0 - q1 * r1 - q2 * r2 - q3 * r3) + ld / 2 - ln(lam) AS score FROM e4)"  # two of the penalty's four are curved
    return sql + ' SELECT z.lam AS "lambda", round(z.score - o.score, 4) AS score FROM z, z o WHERE o.lam = 1'


def _glm(name: str, y, x: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = lines(spark, sf_dir).withColumn("y", y())
        m = fit_gam(df, "y", [Linear(x)], name, opt=Options(local_rows=0))
        return spark.createDataFrame([(float(m.beta[0]), float(m.beta[1]))], "a double, b double").select(F.round("a", 5).alias("intercept"), F.round("b", 5).alias("slope"))

    return query


def _glm_sql(y: str, x: str, mean: str, weight: str, start: str, rounds: int = 9) -> str:
    sql = f"WITH d AS (SELECT CAST({y} AS DOUBLE) AS y, CAST({x} AS DOUBLE) AS x FROM lineitem), s0 AS (SELECT {start} AS a, 0.0::DOUBLE AS b FROM d)"
    for i in range(rounds):
        sql += f""", t{i} AS (SELECT y, x, a, b, {mean} AS m FROM d, s{i}), u{i} AS (SELECT *, {weight} AS w FROM t{i}),
            v{i} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum(w) AS s, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(y - m) AS g, sum((y - m) * x) AS gx FROM u{i}),
            s{i + 1} AS (SELECT a + (sxx * g - sx * gx) / (s * sxx - sx * sx) AS a, b + (s * gx - sx * g) / (s * sxx - sx * sx) AS b FROM v{i})"""
    return sql + f" SELECT round(a, 5) AS intercept, round(b, 5) AS slope FROM s{rounds}"


ROW_SCALE, ROW_TAU = 10.0, 0.8


def quantile_row_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear 0.8 quantile of price by quantity whose loss has a scale for each row, log linear in the discount."""
    df = lines(spark, sf_dir).withColumn("y", F.col("l_extendedprice") / 1000.0)
    q = fit_location_scale(df, "y", [Linear("l_quantity")], ROW_TAU, sigma=ROW_SCALE, scale_terms=[Linear("l_discount")], opt=Options(local_rows=0))
    found = {"intercept": q.model.beta[0], "slope": q.model.beta[1], "scale_intercept": q.log_scale.beta[0], "scale_slope": q.log_scale.beta[1], "mean_scale": q.mean_scale}
    return spark.createDataFrame([tuple(float(v) for v in found.values())], ", ".join(f"{k} double" for k in found)).select(*[F.round(k, 4).alias(k) for k in found])


def _row_scale_sql(rounds: int = 12) -> str:
    """Both means by least squares, and Newton steps on the smoothed check loss from the first."""
    sql = f"""WITH d AS (SELECT l_extendedprice / 1000.0 AS y, CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) AS v FROM lineitem),
        m AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b, stddev_pop(y) / 1000 AS least FROM d),
        l AS (SELECT y, x, v, ln(greatest(abs(y - a - b * x), least)) + {LOG_ABS_NORMAL!r} AS l FROM d, m),
        c AS (SELECT regr_intercept(l, v) AS c0, regr_slope(l, v) AS c1 FROM l), r AS (SELECT avg(exp(c0 + c1 * v)) AS mean FROM l, c),
        e AS (SELECT y, x, {ROW_SCALE} * exp(c0 + c1 * v) / mean AS s FROM l, c, r), s0 AS (SELECT a, b FROM m)"""
    for i in range(rounds):
        sql += f""", t{i} AS (SELECT x, s, a, b, 1 / (1 + exp((a + b * x - y) / s)) AS p FROM e, s{i}), u{i} AS (SELECT x, a, b, p * (1 - p) / (s * s) AS w, (p - {1 - ROW_TAU!r}) / s AS g FROM t{i}),
            v{i} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum(w) AS s, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(g) AS g, sum(g * x) AS gx FROM u{i}),
            s{i + 1} AS (SELECT a + (sxx * g - sx * gx) / (s * sxx - sx * sx) AS a, b + (s * gx - sx * g) / (s * sxx - sx * sx) AS b FROM v{i})"""
    return sql + f" SELECT round(a, 4) AS intercept, round(b, 4) AS slope, round(c0, 4) AS scale_intercept, round(c1, 4) AS scale_slope, round(mean, 4) AS mean_scale FROM s{rounds}, c, r"


CLOSE = 1e-5


def qr_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price by quantity and by quantity plus a little of the discount: columns too much alike for X'X. Effects of the columns behind
    them: what quantity and discount themselves add."""
    df = lines(spark, sf_dir).withColumn("y", F.col("l_extendedprice") / 1000.0).withColumn("near", F.col("l_quantity") + F.lit(CLOSE) * F.col("l_discount"))
    b = fit_gam(df, "y", [Linear("l_quantity"), Linear("near")], opt=Options(local_rows=0, qr=True)).beta
    found = {"intercept": b[0], "quantity": b[1] + b[2], "discount": b[2] * CLOSE}
    return spark.createDataFrame([tuple(float(v) for v in found.values())], ", ".join(f"{k} double" for k in found)).select(*[F.round(k, 4).alias(k) for k in found])


QR_SQL = """WITH m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_extendedprice / 1000.0) AS y FROM lineitem),
    c AS (SELECT l_quantity - q AS a, l_discount - d AS b, l_extendedprice / 1000.0 - y AS y FROM lineitem, m),
    s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS bz FROM c),
    f AS (SELECT (bb * ay - ab * bz) / (aa * bb - ab * ab) AS fq, (aa * bz - ab * ay) / (aa * bb - ab * ab) AS fd FROM s)
    SELECT round(y - fq * q - fd * d, 4) AS intercept, round(fq, 4) AS quantity, round(fd, 4) AS discount FROM f, m"""


# -- binning, order statistics, k-index -----------------------------------------------------------------------------------


def _price_range(df):
    return df.agg(F.min("l_extendedprice"), F.max("l_extendedprice")).first()


def bin_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir)
    lo, hi = _price_range(df)
    i = binning.bin_index(F.col("l_extendedprice"), lo, hi)
    return df.groupBy(i.alias("bin")).agg(F.count("*").alias("n")).select("bin", F.round(binning.bin_centre(F.col("bin"), lo, hi), 4).alias("centre"), "n")


BIN_SQL = """WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
    b AS (SELECT CAST(round((l_extendedprice - lo) / ((hi - lo) / 1000)) AS INTEGER) AS bin, lo, (hi - lo) / 1000 AS w FROM lineitem, r)
    SELECT bin, round(any_value(lo) + bin * any_value(w), 4) AS centre, count(*) AS n FROM b GROUP BY bin"""


def bin_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of weights and of weighted responses by cell and by pairs of cells, in one pass."""
    cells = lines(spark, sf_dir).select((F.col("l_quantity") - 1).cast("int").alias("q"), F.round(F.col("l_discount") * 100).cast("int").alias("d"), (1 + F.col("l_tax")).alias("w"), (F.col("l_extendedprice") / 1000).alias("z"))
    out = binning.cell_sums(cells, ["q", "d"], "w", "z")
    return out.select("q", "d", F.col("gid").cast("int").alias("gid"), F.round("sw", 4).alias("sw"), F.round("swz", 3).alias("swz"))


BIN_GRAM_SQL = """WITH c AS (SELECT CAST(l_quantity - 1 AS INTEGER) AS q, CAST(round(l_discount * 100) AS INTEGER) AS d, 1 + l_tax AS w, l_extendedprice / 1000 AS z FROM lineitem)
    SELECT q, d, CAST(grouping_id(q, d) AS INTEGER) AS gid, round(sum(w), 4) AS sw, round(sum(w * z), 3) AS swz FROM c GROUP BY GROUPING SETS ((q), (d), (d, q))"""


def k_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir).withColumn("tie", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    v = k_index(df, "l_extendedprice", F.col("l_quantity") - F.lit(25.0), "tie")
    return spark.createDataFrame([(round(v, 6),)], "k_index double")


K_SQL = """WITH o AS (SELECT l_quantity - 25 AS r, lag(l_quantity - 25) OVER (ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber) AS p FROM lineitem)
    SELECT round(sum(pow(r - p, 2)) / (2 * var_pop(r) * (count(*) - 1)), 6) AS k_index FROM o"""


def coverage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir).select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("q"))
    taus = (0.1, 0.5, 0.95)
    return spark.createDataFrame([(t, round(v, 4)) for t, v in zip(taus, coverage_shifts(df, "y", "q", taus))], "tau double, shift double")


COVERAGE_SQL = """WITH r AS (SELECT l_extendedprice - l_quantity * 1500 AS r, row_number() OVER (ORDER BY l_extendedprice - l_quantity * 1500) - 1 AS k, count(*) OVER () AS n FROM lineitem)
    SELECT t.tau, round(r.r, 4) AS shift FROM r JOIN (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE)) t(tau) ON r.k = floor((r.n - 1) * t.tau)"""


# -- fits without SQL -----------------------------------------------------------------------------------------------------


def _fit(terms, fam, y=None, **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = lines(spark, sf_dir)
        df = df.withColumn("y", y() if y is not None else F.col("l_extendedprice") / 1000.0)
        return _terms_frame(spark, fit_gam(df, "y", terms(), fam(), opt=Options(**options)))

    return query


def _smooths():
    return [Cubic("l_quantity", 10), BSpline("l_discount", 6)]


def quantile_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir).select("l_quantity", (F.col("l_extendedprice") / 1000.0).alias("y"))
    q = fit_quantile(df, "y", [Cubic("l_quantity", 8)], 0.9)
    return q.transform(df.select("l_quantity").distinct()).withColumn("sigma", F.lit(q.sigma))


def _tuned(preset: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = lines(spark, sf_dir).select("l_quantity", (F.col("l_extendedprice") / 1000.0).alias("y"))
        q = fit_quantile(df, "y", [Cubic("l_quantity", 8)], 0.9, preset=preset)
        return q.transform(df.select("l_quantity").distinct()).withColumn("sigma", F.lit(q.sigma))

    return query


def LINE():  # noqa: N802
    return F.col("l_linenumber").cast("double")


def RETURNED():  # noqa: N802
    return (F.col("l_returnflag") == "R").cast("double")


QUERIES = {
    "cr_knots": cr_knots, "cr_basis": cr_basis, "bs_basis": bs_basis, "gram_small": gram_small, "gam_fixed_lambda_fit": gam_fixed_lambda_fit, "gam_discrete_fixed_fit": gam_discrete_fixed_fit, "parametric_fit": parametric_fit, "re_shrinkage": re_shrinkage, "re_many_levels": re_many_levels, "reml_profile": reml_profile,
    "poisson_pirls": _glm("poisson", LINE, "l_discount"), "logit_pirls": _glm("binomial", RETURNED, "l_quantity"),
    **{f"gam_{k.replace('.', '_')}_fixed_fit": _fixed(k) for k in _LAWS}, **{f"gam_{k}_discrete_fixed_fit": _fixed(k, True) for k in ("poisson", "binomial", "gamma")},
    "bin_compress": bin_compress, "bin_gram": bin_gram, "k_index": k_index_query, "coverage_shift": coverage_query, "quantile_fit": quantile_fit,
    "quantile_row_scale": quantile_row_scale, "qr_fit": qr_fit,
    "quantile_cv_fit": _tuned("quality_oos"), "quantile_kl_fit": _tuned("kl"),
    "gam_reml_fit": _fit(_smooths, lambda: family("gaussian")), "gam_gcv_fit": _fit(_smooths, lambda: family("gaussian"), method="GCV"), "gam_fellner_schall_fit": _fit(_smooths, lambda: family("gaussian"), algorithm="fellner-schall"),
    "gam_discrete_fit": _fit(lambda: [Cubic("l_quantity", 10), Cubic("l_tax", 5)], lambda: family("gaussian"), discrete=True),
    "gam_binomial_fit": _fit(_smooths, lambda: family("binomial"), RETURNED, method="fREML"),
    "gam_poisson_fit": _fit(_smooths, lambda: family("poisson"), LINE, method="fREML"),
    "gam_gamma_fit": _fit(_smooths, lambda: family("gamma", "log"), method="fREML"), "gam_inverse_gaussian_fit": _fit(_smooths, lambda: family("inverse.gaussian"), method="fREML"),
    "gam_negbin_fit": _fit(_smooths, lambda: family("negbin"), LINE, method="fREML"),
    "gam_tweedie_fit": _fit(_smooths, lambda: family("tweedie"), method="fREML"), "gam_scat_fit": _fit(_smooths, lambda: family("scat")),
    "gam_ocat_fit": _fit(_smooths, lambda: family("ocat(3)"), lambda: (F.col("l_linenumber") % 3 + 1).cast("double"), method="fREML"),
    "gam_thin_plate_fit": _fit(lambda: [ThinPlate("l_quantity", 8)], lambda: family("gaussian")),
}
ORACLES = {
    "cr_knots": CR_KNOTS_SQL, "cr_basis": _cr_basis_sql(), "bs_basis": _bs_basis_sql(), "gram_small": _gram_sql(), "gam_fixed_lambda_fit": _fixed_sql(), "gam_discrete_fixed_fit": _fixed_sql("l_extendedprice", "bin", 4, DISCRETE_ROWS), "parametric_fit": PARAMETRIC_SQL, "re_shrinkage": RE_SQL,
    "poisson_pirls": _glm_sql("l_linenumber", "l_discount", "exp(a + b * x)", "m", "ln(avg(y))"),
    "logit_pirls": _glm_sql("CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END", "l_quantity", "1 / (1 + exp(-(a + b * x)))", "m * (1 - m)", "ln(avg(y) / (1 - avg(y)))"),
    **{f"gam_{k.replace('.', '_')}_fixed_fit": _fixed_law_sql(k) for k in _LAWS}, **{f"gam_{k}_discrete_fixed_fit": _fixed_law_sql(k, True) for k in ("poisson", "binomial", "gamma")},
    "re_many_levels": RE_MANY_SQL, "reml_profile": _reml_profile_sql(), "bin_compress": BIN_SQL, "bin_gram": BIN_GRAM_SQL, "k_index": K_SQL, "coverage_shift": COVERAGE_SQL,
    "quantile_row_scale": _row_scale_sql(), "qr_fit": QR_SQL,
}
