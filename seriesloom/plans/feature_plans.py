"""Queries for calendars, splits, resampling and feature engineering."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from seriesloom.operators import calendar as cal
from seriesloom.operators import features as ft
from seriesloom.operators import ordered as o
from seriesloom.plans import bindings as b
from seriesloom.plans.bindings import HOLDOUT, HORIZON, sql
from seriesloom.plans.registry import query
from seriesloom.plans.relational_plans import FUTURE_SQL, W

r6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


@query("future_frame", sql("SELECT id, ds, y FROM fullm UNION ALL SELECT id, ds, NULL FROM ahead", "fullm", ahead=FUTURE_SQL))
def future_frame(spark, sf):
    return cal.future_frame(b.full_months(spark, sf), HORIZON)


@query("future_frame_unbound", sql(f"SELECT id, ds FROM ahead", "fullm", ahead=FUTURE_SQL.replace("(1, 12)", "(1, 52)")))
def future_frame_unbound(spark, sf):
    return cal.future_frame(b.full_months(spark, sf), 52, bind=False)


@query("extend_series", sql("SELECT id, ds, y FROM fullm UNION ALL SELECT id, ds, NULL FROM ahead", "fullm", ahead=FUTURE_SQL.replace("(1, 12)", "(1, 14)")))
def extend_series(spark, sf):
    return cal.future_frame(b.full_months(spark, sf), 14)


@query("split_actual_future", sql("SELECT id, ds, y, 'actual' AS split FROM fullm UNION ALL SELECT id, ds, NULL, 'future' FROM ahead", "fullm", ahead=FUTURE_SQL))
def split_actual_future(spark, sf):
    return cal.mark_future(b.full_months(spark, sf), HORIZON)


@query("split_tail", sql("SELECT id, ds, y, split FROM split", "split"))
def split_tail(spark, sf):
    return cal.split_last_n(b.full_months(spark, sf), HOLDOUT)


@query(
    "split_period",
    sql("SELECT id, ds, y, CASE WHEN ds > (SELECT max(ds) FROM panel) - INTERVAL 14 MONTH THEN 'test' ELSE 'train' END AS split FROM panel", "panel"),
)
def split_period(spark, sf):
    return cal.split_last_period(b.panel(spark, sf).select("id", "ds", "y"), 14)


@query(
    "cv_plan",
    sql(
        """SELECT id, ds, y, s.split_id, CASE WHEN ds > last - to_months(m + back) THEN 'testing' ELSE 'training' END AS key
           FROM panel, (SELECT max(ds) AS last FROM panel), (VALUES ('Slice1', 12, 0), ('Slice2', 12, 12), ('Slice3', 12, 24)) s(split_id, m, back)
           WHERE ds <= last - to_months(back)""",
        "panel",
    ),
)
def cv_plan(spark, sf):
    return cal.cv_plan(b.panel(spark, sf).select("id", "ds", "y"), [12, 12, 12], rolling=12)


@query("kfold")
def kfold(spark, sf):
    return cal.kfold(b.full_months(spark, sf), 6, seed=262)


@query(
    "time_folds",
    sql(
        """SELECT id, ds, y, CAST(least(floor((k - lo) * 6.0 / (hi - lo + 1)), 5) AS INTEGER) AS fold FROM
           (SELECT *, year(ds) * 12 + month(ds) AS k FROM fullm), (SELECT min(year(ds) * 12 + month(ds)) AS lo, max(year(ds) * 12 + month(ds)) AS hi FROM fullm)""",
        "fullm",
    ),
)
def time_folds(spark, sf):
    return cal.time_folds(b.full_months(spark, sf), 6)


@query(
    "calendar_features",
    sql(
        f"""SELECT id, ds, CAST(ds - DATE '1970-01-01' AS BIGINT) AS index_num, CAST(ds - lag(ds) OVER ({W}) AS INTEGER) AS diff,
            CAST(year(ds) AS INTEGER) AS year, CAST(isoyear(ds) AS INTEGER) AS year_iso, CASE WHEN month(ds) <= 6 THEN 1 ELSE 2 END AS half,
            CAST(quarter(ds) AS INTEGER) AS quarter, CAST(month(ds) AS INTEGER) AS month, monthname(ds) AS month_lbl,
            CAST(day(ds) AS INTEGER) AS day, CAST(dayofweek(ds) + 1 AS INTEGER) AS wday, dayname(ds) AS wday_lbl, CAST(day(ds) AS INTEGER) AS mday,
            CAST(ds - CAST(date_trunc('quarter', ds) AS DATE) + 1 AS INTEGER) AS qday, CAST(dayofyear(ds) AS INTEGER) AS yday,
            CAST((dayofyear(ds) - 1) // 7 + 1 AS INTEGER) AS week, CAST(weekofyear(ds) AS INTEGER) AS week_iso,
            CAST((day(ds) - 1) // 7 + 1 AS INTEGER) AS mweek FROM panel""",
        "panel",
    ),
)
def calendar_features(spark, sf):
    return ft.add_calendar(b.panel(spark, sf).select("id", "ds"))


def fourier_sql(k: int) -> str:
    angle = f"({2 * math.pi * k / 12!r} * (year(ds) * 12 + month(ds) - 1))"
    return f"round(sin{angle}, 6) + 0.0 AS sin12_k{k}, round(cos{angle}, 6) + 0.0 AS cos12_k{k}"


@query("fourier_features", sql(f"SELECT id, ds, {', '.join(map(fourier_sql, (1, 2, 3)))} FROM panel", "panel"))
def fourier_features(spark, sf):
    names = [f"{f}12_k{k}" for k in (1, 2, 3) for f in ("sin", "cos")]
    return r6(ft.add_fourier(b.panel(spark, sf).select("id", "ds"), (12,), 3), *names)


@query(
    "log_transform",
    sql(
        """SELECT id, ds, round(ln(1 + y), 6) AS log1p, CASE WHEN y > 0 THEN round(ln(y), 6) END AS log,
           round(ln(y + 1), 6) AS log_offset, round(y, 2) AS back FROM padded""",
        "padded",
    ),
)
def log_transform(spark, sf):
    p = b.padded(spark, sf)
    for how in ft.FORWARD:
        p = p.withColumn(how, F.col("y"))
        p = ft.transform(p, how, how)
    back = ft.inverse_transform(p.withColumn("back", F.col("log1p")), "log1p", "back")
    return r6(back, *ft.FORWARD).withColumn("back", F.round("back", 2)).drop("y")


@query(
    "standardize",
    sql(
        "SELECT id, ds, round((y - avg(y) OVER w) / stddev_samp(y) OVER w, 6) + 0.0 AS z, round(y, 2) AS back FROM padded WINDOW w AS (PARTITION BY id)",
        "padded",
    ),
)
def standardize(spark, sf):
    p = b.padded(spark, sf)
    params = ft.moments_by(p)
    z = ft.standardize(p, params)
    back = ft.unstandardize(z, params, out="back")
    return back.select("id", "ds", F.round("z", 6).alias("z"), F.round("back", 2).alias("back"))


LIM = "(SELECT min(ds - DATE '1970-01-01') AS a, max(ds - DATE '1970-01-01') AS z, min(year(ds)) AS ya, max(year(ds)) AS yz FROM split WHERE split = 'train')"


@query(
    "range_scale",
    sql(
        f"""SELECT id, ds, split, round((ds - DATE '1970-01-01' - a) / (z - a), 6) AS index_num, round((year(ds) - ya) / (yz - ya), 6) AS year
            FROM split, {LIM}""",
        "split",
    ),
)
def range_scale(spark, sf):
    p = cal.split_last_n(b.full_months(spark, sf), HOLDOUT)
    p = p.withColumn("index_num", F.unix_date("ds")).withColumn("year", F.year("ds"))
    scaled = ft.range_scale(p, ft.fit_range(p.where("split = 'train'"), ["index_num", "year"]))
    return r6(scaled.drop("y"), "index_num", "year")


@query("scale_by_sd", sql("SELECT id, ds, split, round(y / (SELECT stddev_samp(y) FROM split WHERE split = 'train'), 6) AS y FROM split", "split"))
def scale_by_sd(spark, sf):
    p = cal.split_last_n(b.full_months(spark, sf), HOLDOUT)
    return r6(ft.scale_sd(p, p.where("split = 'train'"), ["y"]), "y")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
dummy_sql = lambda levels, c: ", ".join(f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"" for v in levels)


@query("one_hot", f"SELECT o_orderkey, {dummy_sql(PRIORITIES[1:], 'o_orderpriority')} FROM orders")
def one_hot(spark, sf):
    return ft.one_hot(b.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


@query("one_hot_full", f"SELECT o_orderkey, {dummy_sql(PRIORITIES, 'o_orderpriority')} FROM orders")
def one_hot_full(spark, sf):
    return ft.one_hot(b.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], drop_first=False)


@query("drop_zero_variance", sql("SELECT id, ds, y, CAST(month(ds) AS INTEGER) AS month FROM panel", "panel"))
def drop_zero_variance(spark, sf):
    p = b.panel(spark, sf).select("id", "ds", "y", F.month("ds").alias("month"), F.dayofmonth("ds").alias("mday"), F.lit(0.0).alias("hour"))
    return ft.drop_zero_variance(p)


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "drop_correlated",
    " UNION ALL ".join(
        f"SELECT '{x}' AS feature_a, '{y}' AS feature_b, round(corr({x}, {y}), 4) + 0.0 AS corr FROM lineitem"
        for i, x in enumerate(NUMBERS)
        for y in NUMBERS[i + 1 :]
    ),
)
def drop_correlated(spark, sf):
    pairs = ft.correlation_pairs(b.table(spark, sf, "lineitem"), NUMBERS)
    out = spark.createDataFrame(pairs, "feature_a string, feature_b string, corr double")
    return out.withColumn("corr", F.round("corr", 4))


@query("drop_correlated_columns", sql("SELECT id, ds, y FROM panel", "panel"))
def drop_correlated_columns(spark, sf):
    p = b.panel(spark, sf).select("id", "ds", "y", (F.col("y") * 2 + 1).alias("twice"))
    return ft.drop_correlated(p, ["twice", "y"])


def model_features(spark, sf):
    """Features of the global models on the padded panel with its future, scaled per series."""
    p = b.full_months(spark, sf)
    logged = ft.transform(p, "log1p")
    train = cal.split_last_n(logged, HOLDOUT).where("split = 'train'")
    z = ft.standardize(logged, ft.moments_by(train), out="y")
    f = ft.add_fourier(ft.add_calendar(cal.future_frame(z, HORIZON)))
    return o.add_rolling(o.add_lags(f, range(1, 7)), "y_lag6", range(1, 7))


PREDICTORS = ["index_num", "year", "half", "quarter", "month", "sin12_k1", "cos12_k1", *[f"y_lag{k}" for k in range(1, 7)]]


@query("feature_prep")
def feature_prep(spark, sf):
    from seriesloom.session import stage

    # the first months of a series have no lags yet
    f = stage(cal.split_last_n(model_features(spark, sf).where("y IS NOT NULL"), HOLDOUT).dropna(subset=PREDICTORS))
    pipe = ft.FeaturePipeline(PREDICTORS, ["id"], indicator=["ds"])
    fitted = pipe.fit(f.where("split = 'train'"))
    return ft.as_array(fitted.transform(f)).select("id", "ds", "split", "y", F.array_join(F.transform("x", lambda v: F.round(v, 4).cast("string")), " ").alias("x"))


ROLES_SQL = """SELECT variable, type, role, CASE WHEN variable IN ('y', 'y_lag1') THEN known ELSE known + ahead END AS n_known FROM
    (SELECT CAST(count(*) AS BIGINT) AS known, CAST(count(DISTINCT id) * 12 AS BIGINT) AS ahead FROM fullm),
    (VALUES ('y_lag1', 'double', 'predictor'), ('sin12_k1', 'double', 'predictor'), ('id', 'int', 'predictor'), ('y', 'double', 'outcome'), ('ds', 'date', 'indicator')) v(variable, type, role)"""


@query("feature_roles", sql(ROLES_SQL, "fullm"))
def feature_roles(spark, sf):
    """Roles and types of the features, with the number of rows that have each."""
    f = model_features(spark, sf)
    roles = ft.FeaturePipeline(["y_lag1", "sin12_k1"], ["id"], indicator=["ds"]).roles(f)
    names = [r.variable for r in roles.collect()]
    known = f.agg(*[F.count(n).alias(n) for n in names]).unpivot([], names, "variable", "n_known")
    return roles.join(known, "variable")
