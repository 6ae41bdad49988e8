"""Tables behind the usual series charts: seasonality, anomalies, autocorrelation, residual tests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.quantiles import exact_quantiles
from seriesloom.functions.tails import chi2_tail

FIVE = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}


def seasonal_profile(panel: DataFrame, value: str = "y", when: str = "ds") -> DataFrame:
    """Five-number summary of the values by month, quarter and year."""
    units = F.array(
        F.struct(F.lit("month").alias("unit"), F.month(when).alias("label")),
        F.struct(F.lit("quarter").alias("unit"), F.quarter(when).alias("label")),
        F.struct(F.lit("year").alias("unit"), F.year(when).alias("label")),
    )
    return exact_quantiles(panel.select(value, F.inline(units)), ["unit", "label"], value, FIVE)


def decompose(panel: DataFrame, value: str = "y", key: str = "id", when: str = "ds") -> DataFrame:
    """Trend (2x12 moving average), month effect and remainder per series."""
    w = Window.partitionBy(key).orderBy(when)
    early, late = w.rowsBetween(-6, 5), w.rowsBetween(-5, 6)
    inner = (F.count(value).over(early) == 12) & (F.count(value).over(late) == 12)
    trend = F.when(inner, (F.avg(value).over(early) + F.avg(value).over(late)) / 2)
    t = panel.withColumn("trend", trend).withColumn("_moy", F.month(when))
    t = t.withColumn("_mm", F.avg(F.col(value) - F.col("trend")).over(Window.partitionBy(key, "_moy")))
    # every month counts once in the centre, however often it was seen
    seen = Window.partitionBy(key, "_moy").orderBy(when)
    once = F.when(F.row_number().over(seen) == 1, F.col("_mm"))
    t = t.withColumn("_once", once)
    t = t.withColumn("season", F.col("_mm") - F.avg("_once").over(Window.partitionBy(key)))
    return t.withColumn("remainder", F.col(value) - F.col("trend") - F.col("season")).drop("_moy", "_mm", "_once")


def anomalies(panel: DataFrame, alpha: float = 0.05, value: str = "y", key: str = "id", when: str = "ds") -> DataFrame:
    """Flag rows whose remainder lies outside the interquartile fence of their series."""
    parts = decompose(panel, value, key, when)
    # one value per calendar period and series, so the exact percentile is bounded
    fence = parts.groupBy(key).agg(F.percentile("remainder", [0.25, 0.75]).alias("_q"))
    k = 0.15 / alpha
    iqr = F.col("_q")[1] - F.col("_q")[0]
    low, high = F.col("_q")[0] - k * iqr, F.col("_q")[1] + k * iqr
    outside = (F.col("remainder") < low) | (F.col("remainder") > high)
    return parts.join(fence, key).withColumn("anomaly", outside).drop("_q")


def lag_products(df: DataFrame, by: Sequence[str], value: str, lags: Sequence[int], when: str = "ds") -> DataFrame:
    """Per group: n, sum of squares and the lagged product sums of the centred values, in one window pass."""
    w = Window.partitionBy(*by).orderBy(when)
    d = df.withColumn("_d", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))
    d = d.select(*by, "_d", *[F.lag("_d", k).over(w).alias(f"_l{k}") for k in lags])
    return d.groupBy(*by).agg(
        F.count("_d").alias("n"),
        F.sum(F.col("_d") * F.col("_d")).alias("_ss"),
        F.array(*[F.coalesce(F.sum(F.col("_d") * F.col(f"_l{k}")), F.lit(0.0)) for k in lags]).alias("_lp"),
    )


def acf(panel: DataFrame, max_lag: int = 12, value: str = "y", key: str = "id", when: str = "ds") -> DataFrame:
    """Autocorrelation per lag with the white-noise band."""
    sums = lag_products(panel, [key], value, range(1, max_lag + 1), when)
    r = F.transform("_lp", lambda s: F.when(F.col("_ss") > 0, s / F.col("_ss")))
    out = sums.select(key, "n", F.posexplode(r).alias("lag", "acf"))
    return out.withColumn("lag", F.col("lag") + 1).withColumn("band", F.lit(1.96) / F.sqrt("n"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def durbin_levinson(r: pd.Series) -> pd.Series:
    """Partial autocorrelations from autocorrelations at lags 1, 2, ..., for a batch of series at once."""
    rows = np.array([np.asarray(v, dtype=float) for v in r])
    phi = np.zeros_like(rows)
    out = np.full_like(rows, np.nan)
    for k in range(rows.shape[1]):
        prev = phi[:, :k].copy()
        den = 1.0 - (prev * rows[:, :k]).sum(axis=1)
        with np.errstate(all="ignore"):
            last = (rows[:, k] - (prev * rows[:, :k][:, ::-1]).sum(axis=1)) / den
        phi[:, :k] = prev - last[:, None] * prev[:, ::-1]
        phi[:, k] = last
        out[:, k] = last
    return pd.Series(list(out))


def pacf(panel: DataFrame, max_lag: int = 12, value: str = "y", key: str = "id", when: str = "ds") -> DataFrame:
    """Partial autocorrelation per lag; series without variation are left out."""
    sums = lag_products(panel, [key], value, range(1, max_lag + 1), when).where(F.col("_ss") > 0)
    r = F.transform("_lp", lambda s: s / F.col("_ss"))
    out = sums.select(key, "n", F.posexplode(durbin_levinson(r)).alias("lag", "pacf"))
    return out.withColumn("lag", F.col("lag") + 1).withColumn("band", F.lit(1.96) / F.sqrt("n"))


def ts_regression(df: DataFrame, predictors: Sequence[str], value: str = "y") -> DataFrame:
    """Linear regression by normal equations: one row per coefficient with its error, t, p and the fit's R squared."""
    known = df.select(*predictors, value).dropna()  # the usual rule: rows that lack a term or the outcome are left out
    rows = VectorAssembler(inputCols=list(predictors), outputCol="features", handleInvalid="error").transform(known)
    model = LinearRegression(labelCol=value, solver="normal").fit(rows)
    s = model.summary
    names = [*predictors, "(Intercept)"]
    estimates = [*model.coefficients.toArray().tolist(), model.intercept]
    table = [
        (n, float(b), float(se), float(t), float(p), float(s.r2), float(s.r2adj))
        for n, b, se, t, p in zip(names, estimates, s.coefficientStandardErrors, s.tValues, s.pValues)
    ]
    return df.sparkSession.createDataFrame(
        table, "term string, estimate double, std_error double, t double, p_value double, rsq double, rsq_adj double"
    )


def trend_regression(panel: DataFrame, value: str = "y", key: str = "id", when: str = "ds") -> DataFrame:
    """Straight line through each series: slope per month, intercept, R squared."""
    t = (F.year(when) * 12 + F.month(when)).cast("double")
    p = panel.withColumn("_t", t)
    return p.groupBy(key).agg(
        F.regr_slope(value, "_t").alias("slope"),
        F.regr_intercept(value, "_t").alias("intercept"),
        F.regr_r2(value, "_t").alias("rsq"),
        F.regr_count(value, "_t").alias("n"),
    )


def loess(df: DataFrame, x: str, y: str, span: float = 0.75, by: Sequence[str] = (), n_points: int = 80) -> DataFrame:
    """Locally weighted line through the nearest ``ceil(span * n)`` points of each group.

    Meant for tuning results and single series. ``n_points`` bounds the frame that is gathered
    around each point; a larger group is refused rather than cut.
    """
    groups = list(by) or [F.lit(1)]
    part = Window.partitionBy(*groups)
    w = part.orderBy(x)
    sized = df.withColumn("_n", F.count(F.lit(1)).over(part))
    sized = sized.withColumn("_q", F.ceil(F.col("_n") * F.lit(span)).cast("int"))
    checked = F.assert_true(F.col("_n") <= n_points, F.lit("group is larger than n_points"))
    near = F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))).over(
        w.rowsBetween(-n_points, n_points)
    )
    by_distance = lambda pts: F.array_sort(
        F.transform(pts, lambda p: F.struct(F.abs(p["x"] - F.col(x)).alias("d"), p["x"].alias("x"), p["y"].alias("y")))
    )
    framed = sized.where(checked.isNull()).withColumn("_p", F.slice(by_distance(near), 1, F.col("_q")))
    framed = framed.withColumn("_h", F.element_at("_p", -1)["d"])

    def tricube(p):
        u = p["d"] / F.col("_h")
        return F.when(F.col("_h") > 0, F.pow(1 - F.pow(u, 3), 3)).otherwise(F.lit(1.0))

    def weighted(f):
        return F.aggregate(F.transform("_p", lambda p: tricube(p) * f(p)), F.lit(0.0), lambda s, v: s + v)

    dx = lambda p: p["x"] - F.col(x)
    sums = framed.select(
        *df.columns,
        weighted(lambda p: F.lit(1.0)).alias("_s0"),
        weighted(dx).alias("_s1"),
        weighted(lambda p: dx(p) * dx(p)).alias("_s2"),
        weighted(lambda p: p["y"]).alias("_t0"),
        weighted(lambda p: dx(p) * p["y"]).alias("_t1"),
    )
    det = F.col("_s0") * F.col("_s2") - F.col("_s1") * F.col("_s1")
    level = (F.col("_s2") * F.col("_t0") - F.col("_s1") * F.col("_t1")) / det
    fit = F.when(F.abs(det) > 1e-12, level).otherwise(F.col("_t0") / F.col("_s0"))
    return sums.withColumn("smooth", fit).select(*df.columns, "smooth")


def residuals(forecast: DataFrame, panel: DataFrame, key: str = "id", when: str = "ds", value: str = "y") -> DataFrame:
    """Actual minus predicted per row of a forecast table."""
    actual = panel.select(key, when, F.col(value).alias("actual"))
    return forecast.join(actual, [key, when]).withColumn("resid", F.col("actual") - F.col("value"))


def residual_tests(resid: DataFrame, by: Sequence[str], lag: int = 1, value: str = "resid", when: str = "ds") -> DataFrame:
    """Jarque-Bera, Box-Pierce, Ljung-Box and Durbin-Watson per group, with p-values for the first three."""
    w = Window.partitionBy(*by).orderBy(when)
    e = F.col(value)
    step = resid.withColumn("_step", e - F.lag(value).over(w)).withColumn("_m", F.avg(value).over(Window.partitionBy(*by)))
    c = e - F.col("_m")
    shape = step.groupBy(*by).agg(
        (F.sum(F.pow("_step", F.lit(2.0))) / F.sum(F.pow(e, F.lit(2.0)))).alias("durbin_watson"),
        F.avg(F.pow(c, F.lit(2.0))).alias("_m2"),
        F.avg(F.pow(c, F.lit(3.0))).alias("_m3"),
        F.avg(F.pow(c, F.lit(4.0))).alias("_m4"),
    )
    skew = F.col("_m3") / F.pow("_m2", F.lit(1.5))
    excess = F.col("_m4") / F.pow("_m2", F.lit(2.0)) - 3
    out = portmanteau(resid, by, lag, value, when).join(shape, list(by))
    out = out.withColumn("jarque_bera", F.col("n") / 6 * (skew * skew + excess * excess / 4))
    out = out.withColumn("jarque_bera_p", chi2_tail(F.col("jarque_bera"), 2))
    return out.drop("_m2", "_m3", "_m4")


def portmanteau(resid: DataFrame, by: Sequence[str], lag: int, value: str = "resid", when: str = "ds") -> DataFrame:
    sums = lag_products(resid, by, value, range(1, lag + 1), when).where(F.col("_ss") > 0)
    r2 = F.transform("_lp", lambda s: F.pow(s / F.col("_ss"), F.lit(2.0)))
    plain = F.aggregate(r2, F.lit(0.0), lambda s, v: s + v)
    weighted = F.transform(r2, lambda v, i: v / (F.col("n") - i - 1))
    out = sums.select(
        *by,
        "n",
        (F.col("n") * plain).alias("box_pierce"),
        (F.col("n") * (F.col("n") + 2) * F.aggregate(weighted, F.lit(0.0), lambda s, v: s + v)).alias("ljung_box"),
    )
    return out.withColumn("box_pierce_p", chi2_tail(F.col("box_pierce"), lag)).withColumn(
        "ljung_box_p", chi2_tail(F.col("ljung_box"), lag)
    )


def ljung_box(resid: DataFrame, lag: int = 12, by: Sequence[str] = ("id", "model_id"), value: str = "resid", when: str = "ds") -> DataFrame:
    """Ljung-Box statistic and p-value per series and model."""
    return portmanteau(resid, by, lag, value, when).select(*by, "n", "ljung_box", "ljung_box_p")
