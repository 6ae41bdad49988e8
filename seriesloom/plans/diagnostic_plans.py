"""Queries for the tables behind diagnostic charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.columns import money
from seriesloom.operators import diagnostics as dg
from seriesloom.operators import features as ft
from seriesloom.operators import ordered as o
from seriesloom.operators import rollup as u
from seriesloom.plans import bindings as b
from seriesloom.plans.bindings import sql
from seriesloom.plans.registry import query

r = lambda df, digits, *cols: df.withColumns({c: F.round(c, digits) for c in cols})

UNITS = {"month": "month(ds)", "quarter": "quarter(ds)", "year": "year(ds)"}


@query(
    "seasonal_profile",
    sql(
        " UNION ALL ".join(
            f"""SELECT '{u}' AS unit, CAST({e} AS INTEGER) AS label, CAST(count(y) AS BIGINT) AS n, round(min(y), 4) AS p0,
                round(quantile_cont(y, 0.25), 4) AS p25, round(quantile_cont(y, 0.5), 4) AS p50, round(quantile_cont(y, 0.75), 4) AS p75,
                round(max(y), 4) AS p100 FROM fullm GROUP BY 2"""
            for u, e in UNITS.items()
        ),
        "fullm",
    ),
)
def seasonal_profile(spark, sf):
    return r(dg.seasonal_profile(b.full_months(spark, sf)), 4, *dg.FIVE)


W = "PARTITION BY id ORDER BY ds"


@query(
    "anomalies",
    sql(
        """SELECT id, ds, round(y, 2) AS y, round(trend + 1e-7, 4) AS trend, round(season + 1e-7, 4) AS season, round(remainder + 1e-7, 4) AS remainder,
           remainder < q1 - 3 * (q3 - q1) OR remainder > q3 + 3 * (q3 - q1) AS anomaly FROM parts JOIN fence USING (id)""",
        "padded",
        tr=f"""SELECT id, ds, y, CASE WHEN count(y) OVER a = 12 AND count(y) OVER z = 12 THEN (avg(y) OVER a + avg(y) OVER z) / 2 END AS trend
               FROM padded WINDOW a AS ({W} ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING), z AS ({W} ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)""",
        mm="SELECT id, month(ds) AS moy, avg(y - trend) AS m FROM tr GROUP BY 1, 2",
        parts="""SELECT t.*, m - c AS season, y - trend - (m - c) AS remainder FROM tr t JOIN mm ON mm.id = t.id AND mm.moy = month(t.ds)
                 JOIN (SELECT id, avg(m) AS c FROM mm GROUP BY id) x ON x.id = t.id""",
        fence="SELECT id, quantile_cont(remainder, 0.25) AS q1, quantile_cont(remainder, 0.75) AS q3 FROM parts GROUP BY id",
    ),
)
def anomalies(spark, sf):
    out = dg.anomalies(b.padded(spark, sf))
    # means of cents meet exact ties; both sides move them off the tie
    out = out.withColumns({c: F.round(F.col(c) + 1e-7, 4) for c in ("trend", "season", "remainder")})
    return r(out, 2, "y")


ACF_CTES = dict(
    d=f"SELECT id, y - avg(y) OVER (PARTITION BY id) AS d, row_number() OVER ({W}) AS t FROM fullm",
    s="SELECT id, count(*) AS n, sum(d * d) AS ss FROM d GROUP BY id",
)


@query(
    "acf",
    sql(
        """SELECT a.id, CAST(k AS INTEGER) AS lag, CAST(any_value(n) AS BIGINT) AS n, round(sum(a.d * z.d) / any_value(ss), 6) + 0.0 AS acf,
           round(1.96 / sqrt(any_value(n)), 6) AS band FROM d a JOIN s ON s.id = a.id, generate_series(1, 12) g(k)
           JOIN d z ON z.id = a.id AND z.t = a.t - k GROUP BY 1, 2""",
        "fullm",
        **ACF_CTES,
    ),
)
def acf(spark, sf):
    return r(dg.acf(b.full_months(spark, sf), 12), 6, "acf", "band")


@query(
    "pacf",
    sql(
        """SELECT * FROM (SELECT id, 1 AS lag, round(r1, 6) + 0.0 AS pacf FROM two UNION ALL
           SELECT id, 2, round((r2 - r1 * r1) / (1 - r1 * r1), 6) + 0.0 FROM two)""",
        "fullm",
        **ACF_CTES,
        two="""SELECT a.id, sum(CASE WHEN z.t = a.t - 1 THEN a.d * z.d END) / any_value(ss) AS r1,
               sum(CASE WHEN z.t = a.t - 2 THEN a.d * z.d END) / any_value(ss) AS r2
               FROM d a JOIN s ON s.id = a.id JOIN d z ON z.id = a.id AND z.t BETWEEN a.t - 2 AND a.t - 1 GROUP BY a.id""",
    ),
)
def pacf(spark, sf):
    return dg.pacf(b.full_months(spark, sf), 2).select("id", "lag", F.round("pacf", 6).alias("pacf"))


@query("pacf_12")
def pacf_12(spark, sf):
    return r(dg.pacf(b.full_months(spark, sf), 12), 6, "pacf", "band")


@query("ts_regression")
def ts_regression(spark, sf):
    total = u.agg_total(money(b.full_months(spark, sf), "y")).withColumn("id", F.lit(0))
    f = o.add_rolling(o.add_lags(ft.add_calendar(total), (3, 6)), "y_lag3", [3])
    return dg.ts_regression(f, ["index_num", "quarter", "month", "y_lag3", "y_lag6", "y_lag3_roll3"])


@query(
    "ts_regression_trend",
    sql(
        """SELECT id, round(regr_slope(y, t), 4) AS slope, round(regr_intercept(y, t), 0) AS intercept, round(regr_r2(y, t), 6) AS rsq,
           CAST(regr_count(y, t) AS BIGINT) AS n FROM (SELECT id, y, CAST(year(ds) * 12 + month(ds) AS DOUBLE) AS t FROM fullm) GROUP BY id""",
        "fullm",
    ),
)
def ts_regression_trend(spark, sf):
    out = dg.trend_regression(b.full_months(spark, sf))
    return r(r(r(out, 4, "slope"), 0, "intercept"), 6, "rsq")


@query(
    "smooth_local",
    sql(
        """SELECT id, ds, round(CASE WHEN abs(s0 * s2 - s1 * s1) > 1e-12 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END, 2) AS smooth FROM (
             SELECT id, ds, sum(w) AS s0, sum(w * dx) AS s1, sum(w * dx * dx) AS s2, sum(w * y) AS t0, sum(w * dx * y) AS t1
             FROM (SELECT *, power(1 - power(d / h, 3), 3) AS w FROM (
               SELECT *, max(d) OVER (PARTITION BY id, ds) AS h FROM near WHERE rn <= ceil(n * 0.4))) GROUP BY 1, 2)""",
        "fullm",
        tt=f"SELECT id, ds, y, row_number() OVER ({W}) AS t, count(*) OVER (PARTITION BY id) AS n FROM fullm",
        near="""SELECT a.id, a.ds, a.n, z.y, z.t - a.t AS dx, abs(z.t - a.t) AS d,
                row_number() OVER (PARTITION BY a.id, a.ds ORDER BY abs(z.t - a.t), z.t) AS rn FROM tt a JOIN tt z ON z.id = a.id""",
    ),
)
def smooth_local(spark, sf):
    from pyspark.sql import Window

    t = b.full_months(spark, sf).withColumn("t", F.row_number().over(Window.partitionBy("id").orderBy("ds")))
    return dg.loess(t, "t", "y", 0.4, ["id"], n_points=2000).select("id", "ds", F.round("smooth", 2).alias("smooth"))


RES = "SELECT id, model_id, ds, y - value AS e FROM fc JOIN fullm USING (id, ds)"


@query("residuals", sql("SELECT id, model_id, model_desc, ds, value, y AS actual, round(y - value, 2) AS resid FROM fc JOIN fullm USING (id, ds)", "fc"))
def residuals(spark, sf):
    return r(dg.residuals(b.baseline_forecasts(spark, sf), b.full_months(spark, sf)), 2, "resid")


def stats_ctes(lags: int) -> dict:
    return dict(
        e=RES,
        c="SELECT *, e - avg(e) OVER (PARTITION BY id, model_id) AS d, row_number() OVER (PARTITION BY id, model_id ORDER BY ds) AS t, lag(e) OVER (PARTITION BY id, model_id ORDER BY ds) AS pe FROM e",
        m="""SELECT id, model_id, count(*) AS n, sum(d * d) AS ss, avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4,
             sum((e - pe) * (e - pe)) / sum(e * e) AS dw FROM c GROUP BY 1, 2""",
        rk=f"""SELECT a.id, a.model_id, k, sum(a.d * z.d) / any_value(ss) AS r, any_value(n) AS n FROM c a JOIN m ON m.id = a.id AND m.model_id = a.model_id,
              generate_series(1, {lags}) g(k) JOIN c z ON z.id = a.id AND z.model_id = a.model_id AND z.t = a.t - k WHERE ss > 0 GROUP BY 1, 2, 3""",
        q="SELECT id, model_id, any_value(n) * sum(r * r) AS bp, any_value(n) * (any_value(n) + 2) * sum(r * r / (n - k)) AS lb FROM rk GROUP BY 1, 2",
    )


@query(
    "residual_tests",
    sql(
        """SELECT id, model_id, CAST(n AS BIGINT) AS n, round(bp, 4) AS box_pierce, round(lb, 4) AS ljung_box, round(exp(-bp / 2) * (1 + bp / 2), 4) AS box_pierce_p,
           round(exp(-lb / 2) * (1 + lb / 2), 4) AS ljung_box_p, round(dw, 4) AS durbin_watson, round(jb, 4) AS jarque_bera, round(exp(-jb / 2), 4) AS jarque_bera_p FROM (
           SELECT *, n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4) AS jb FROM m JOIN q USING (id, model_id))""",
        "fc",
        **stats_ctes(4),
    ),
)
def residual_tests(spark, sf):
    e = dg.residuals(b.baseline_forecasts(spark, sf), b.full_months(spark, sf))
    out = dg.residual_tests(e, ["id", "model_id"], 4)
    return r(out, 4, "box_pierce", "ljung_box", "box_pierce_p", "ljung_box_p", "durbin_watson", "jarque_bera", "jarque_bera_p")


LB12 = " + ".join(f"power(lb / 2, {i}) / {f}" for i, f in enumerate((1, 1, 2, 6, 24, 120)))


@query(
    "ljung_box",
    sql(
        f"SELECT id, model_id, CAST(n AS BIGINT) AS n, round(lb, 4) AS ljung_box, round(exp(-lb / 2) * ({LB12}), 4) AS ljung_box_p FROM m JOIN q USING (id, model_id)",
        "fc",
        **{**stats_ctes(12), "e": "SELECT id, 1 AS model_id, ds, y - lag(y, 12) OVER (PARTITION BY id ORDER BY ds) AS e FROM fullm QUALIFY e IS NOT NULL"},
    ),
)
def ljung_box(spark, sf):
    yearly = o.add_lags(b.full_months(spark, sf), [12]).where("y_lag12 IS NOT NULL")
    e = yearly.select("id", F.lit(1).alias("model_id"), "ds", (F.col("y") - F.col("y_lag12")).alias("resid"))
    return r(dg.ljung_box(e, 12), 4, "ljung_box", "ljung_box_p")
