"""M1: ordinary least squares of y on one regressor plus an intercept.

The fit is one distributed aggregation (Spark's ``regr_*`` aggregates merge
partial moments, so the data is never gathered). Everything after that works
on one row: standard errors, t values, and the Student-t tail probabilities,
which need the regularised incomplete beta function. scipy is not available,
so that function is a short continued fraction evaluated in an Arrow-batched
pandas UDF on the one-row result.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxlens.session import freeze


# Ship this module's helpers with the UDF instead of importing the package on
# the workers: executors then need nothing installed besides PySpark.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            return h
    raise ArithmeticError(f"the continued fraction did not converge at a={a}, b={b}, x={x}")


def _log_half_step(a: float) -> float:
    """log(gamma(a + 1/2) / gamma(a)): its series at 20 and more, reached by the
    recurrence; the difference of two large log-gammas would lose digits."""
    shift = 0.0
    while a < 20.0:
        shift += math.log(a / (a + 0.5))
        a += 1.0
    r = 1.0 / a
    return shift + 0.5 * math.log(a) + r * (-1 / 8 + r * r * (1 / 192 + r * r * (-1 / 640 + r * r * 17 / 14336)))


def betainc(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta I_x(a, b); ``y`` is 1 - x where it is known
    more exactly than x gives it."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    if b == 0.5:
        log_norm = _log_half_step(a) - 0.5 * math.log(math.pi)
    else:
        log_norm = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    log_bt = log_norm + a * (math.log1p(-y) if y < 0.5 else math.log(x)) + b * math.log(y)
    bt = math.exp(log_bt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, y) / b


def t_two_sided_p(t: float, dof: float) -> float:
    """P(|T| > |t|) for Student's t with ``dof`` degrees of freedom."""
    if t is None or dof is None or not (dof > 0) or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t), t * t / (dof + t * t))


def t_critical(dof: float, level: float = 0.95) -> float:
    """Two-sided critical value: t with P(|T| > t) = 1 - level (bisection)."""
    if dof is None or not (dof > 0):
        return float("nan")
    target = 1.0 - level
    lo, hi = 0.0, 1.0
    while t_two_sided_p(hi, dof) > target:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if t_two_sided_p(mid, dof) > target:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


@F.pandas_udf(T.DoubleType())
def _p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(a, b) for a, b in zip(t, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _t_crit(dof: pd.Series) -> pd.Series:
    return pd.Series([t_critical(b) for b in dof], dtype="float64")


def _div(a, b):
    """Division that gives NULL for a zero divisor (degenerate fits) instead
    of failing under ANSI mode."""
    return F.try_divide(a, b)


def _moments(df: DataFrame, x: str, y: str) -> DataFrame:
    yc, xc = F.col(y).cast("double"), F.col(x).cast("double")
    m = df.agg(
        F.regr_count(yc, xc).alias("n"),
        F.regr_slope(yc, xc).alias("slope"),
        F.regr_intercept(yc, xc).alias("intercept"),
        F.regr_r2(yc, xc).alias("r2"),
        F.regr_sxx(yc, xc).alias("sxx"),
        F.regr_syy(yc, xc).alias("syy"),
        F.regr_sxy(yc, xc).alias("sxy"),
        F.regr_avgx(yc, xc).alias("avgx"),
    )
    n = F.col("n").cast("double")
    m = m.withColumn("sse", F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)))
    m = m.withColumn("df_resid", F.when(n > 0, n - 2))
    m = m.withColumn("s2", _div(F.col("sse"), F.col("df_resid")))
    return m


def ols_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, slope, intercept, R2, adjusted R2, F, log-likelihood, AIC, BIC."""
    m = _moments(df, x, y)
    n = F.col("n").cast("double")
    t_slope = _div(F.col("slope"), F.sqrt(_div(F.col("s2"), F.col("sxx"))))
    loglik = -n / 2 * (F.log(F.lit(2 * math.pi)) + F.log(_div(F.col("sse"), n)) + 1)
    return m.select(
        "n", "slope", "intercept", "r2",
        (1 - _div((1 - F.col("r2")) * (n - 1), F.col("df_resid"))).alias("adj_r2"),
        (t_slope * t_slope).alias("f_stat"),
        "df_resid",
        loglik.alias("log_likelihood"),
        (-2 * loglik + 4).alias("aic"),
        (-2 * loglik + 2 * F.log(n)).alias("bic"),
    )


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """Coefficient table: term, coef, std_err, t, p_value, ci_low, ci_high
    (rows 'const' and ``x``), like a regression summary."""
    m = _moments(df, x, y)
    n = F.col("n").cast("double")
    se_slope = F.sqrt(_div(F.col("s2"), F.col("sxx")))
    se_int = F.sqrt(F.col("s2") * (_div(F.lit(1.0), n) + _div(F.col("avgx") * F.col("avgx"), F.col("sxx"))))
    rows = m.select(
        "df_resid",
        F.explode(F.array(
            F.struct(F.lit("const").alias("term"), F.col("intercept").alias("coef"), se_int.alias("std_err")),
            F.struct(F.lit(x).alias("term"), F.col("slope").alias("coef"), se_slope.alias("std_err")),
        )).alias("r"),
    ).select("df_resid", "r.*")
    rows = rows.withColumn("t", _div(F.col("coef"), F.col("std_err")))
    rows = rows.withColumn("p_value", _p_value(F.col("t"), F.col("df_resid")))
    crit = _t_crit(F.col("df_resid"))
    return rows.select(
        "term", "coef", "std_err", "t", "p_value",
        (F.col("coef") - crit * F.col("std_err")).alias("ci_low"),
        (F.col("coef") + crit * F.col("std_err")).alias("ci_high"),
    )


def ols_diagnostics(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row of residual diagnostics of the same fit, like a regression
    summary: skew, kurtosis (Pearson, not excess), Omnibus (D'Agostino-Pearson
    K^2) with its p-value, Jarque-Bera with its p-value, and the condition
    number of the design matrix [1, x].

    The residuals need the fitted line, taken as one scalar subquery of the
    moments aggregate over the frozen (x, y) rows; the central moments of the
    residuals are one more distributed aggregation over the same rows. The test statistics are closed-form expressions
    of those moments (chi-square with two degrees of freedom has survival
    exp(-s/2)), so everything stays in Spark expressions.
    """
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    # the (x, y) rows are read twice (fit, residuals): freeze them once
    pairs = freeze(df.select(xc.alias(x), yc.alias(y)).filter(F.col(x).isNotNull() & F.col(y).isNotNull()))
    line = _moments(pairs, x, y).select(F.struct("slope", "intercept")).scalar()
    slope, intercept = line.getField("slope"), line.getField("intercept")
    xc, yc = F.col(x), F.col(y)
    resid = pairs.select((yc - (intercept + slope * xc)).alias("e"), xc.alias("x"))
    mom = resid.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.skewness("e").alias("skew"),
        (F.kurtosis("e") + 3).alias("kurt"),
        F.sum("x").alias("sx"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"),
    )
    n, g1, b2 = F.col("n"), F.col("skew"), F.col("kurt")
    # The two normality tests are defined for n >= 8; below that (and for a
    # zero divisor anywhere) the statistics are NULL rather than an error.
    valid = n >= 8

    # D'Agostino skewness test
    yv = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta2 - 1))
    delta = _div(F.lit(1.0), F.sqrt(0.5 * F.log(w2)))
    alpha = F.sqrt(_div(F.lit(2.0), w2 - 1))
    yv = F.when(yv == 0, F.lit(1.0)).otherwise(yv)
    ya = _div(yv, alpha)
    z_skew = delta * F.log(ya + F.sqrt(ya * ya + 1))
    # Anscombe-Glynn kurtosis test
    e_b2 = 3.0 * (n - 1) / (n + 1)
    var_b2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    xk = _div(b2 - e_b2, F.sqrt(var_b2))
    sqrt_beta1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(
        6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))
    )
    a = 6.0 + 8.0 / sqrt_beta1 * (2.0 / sqrt_beta1 + F.sqrt(1 + 4.0 / (sqrt_beta1 * sqrt_beta1)))
    term1 = 1 - 2 / (9.0 * a)
    denom = 1 + xk * F.sqrt(2 / (a - 4.0))
    term2 = F.when(denom != 0, F.signum(denom) * F.pow(_div(1 - 2.0 / a, F.abs(denom)), F.lit(1 / 3.0)))
    z_kurt = (term1 - term2) / F.sqrt(2 / (9.0 * a))
    omnibus = F.when(valid, z_skew * z_skew + z_kurt * z_kurt)
    jb = F.when(n > 0, n / 6.0 * (g1 * g1 + (b2 - 3) * (b2 - 3) / 4.0))
    # eigenvalues of X'X = [[n, sx], [sx, sxx]]
    tr, det = n + F.col("sxx"), n * F.col("sxx") - F.col("sx") * F.col("sx")
    disc = F.sqrt(tr * tr - 4 * det)
    cond = F.sqrt(_div(tr + disc, tr - disc))
    return mom.select(
        "skew", F.col("kurt").alias("kurtosis"),
        omnibus.alias("omnibus"), F.exp(-omnibus / 2).alias("prob_omnibus"),
        jb.alias("jarque_bera"), F.exp(-jb / 2).alias("prob_jarque_bera"),
        cond.alias("cond_no"),
    )


def durbin_watson(df: DataFrame, x: str, y: str, order_by: list[str] | None = None) -> DataFrame:
    """One row ``[durbin_watson]``: sum of squared successive residual
    differences over the sum of squared residuals, rows ordered by (x, y).

    Rows with equal (x, y) have equal residuals, so a run of them adds nothing
    to the numerator: only the borders between consecutive distinct pairs do.
    Within one x the residuals differ as the y do, and from one x to the next
    only the last and the first y matter. So the rows are counted per (x, y)
    and nothing else is ordered: the distinct y inside each x, and one row per
    distinct x. ``order_by`` may only name (x, y).
    """
    if order_by is not None and list(order_by) != [x, y]:
        raise ValueError("rows are ordered by (x, y)")
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.select(xc.alias("_x"), yc.alias("_y")).filter(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    pairs = freeze(rows.groupBy("_x", "_y").agg(F.count(F.lit(1)).cast("double").alias("_n")))
    n = F.sum("_n")
    means = pairs.agg((F.sum(F.col("_n") * F.col("_x")) / n).alias("mx"), (F.sum(F.col("_n") * F.col("_y")) / n).alias("my"))
    mean = means.select(F.struct("mx", "my")).scalar()
    dx, dy = F.col("_x") - mean.getField("mx"), F.col("_y") - mean.getField("my")
    centred = pairs.select("_x", "_y", "_n", dx.alias("_dx"), dy.alias("_dy"))
    slope = centred.agg(
        _div(F.sum(F.col("_n") * F.col("_dx") * F.col("_dy")), F.sum(F.col("_n") * F.col("_dx") * F.col("_dx"))).alias("b")).scalar()
    resid = centred.select("_x", "_y", "_n", (F.col("_dy") - slope * F.col("_dx")).alias("_e"))
    inner = F.lag("_y").over(Window.partitionBy("_x").orderBy("_y"))
    per_x = resid.withColumn("_step", F.col("_y") - inner).groupBy("_x").agg(
        F.coalesce(F.sum(F.col("_step") * F.col("_step")), F.lit(0.0)).alias("_inside"),
        F.min("_e").alias("_first"), F.max("_e").alias("_last"),  # residuals rise with y inside an x
        F.sum(F.col("_n") * F.col("_e") * F.col("_e")).alias("_squares"))
    gap = F.col("_first") - F.lag("_last").over(Window.orderBy("_x"))  # one row per distinct x
    return per_x.withColumn("_gap", gap).agg(
        _div(F.sum("_inside") + F.coalesce(F.sum(F.col("_gap") * F.col("_gap")), F.lit(0.0)), F.sum("_squares")).alias("durbin_watson"))
