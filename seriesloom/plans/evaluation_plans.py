"""Queries for accuracy, selection, ensembles, intervals and scenarios over a forecast table that SQL can rebuild."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import blend as bl
from seriesloom.operators import calendar as cal
from seriesloom.operators import evaluate as ev
from seriesloom.operators import rollup as u
from seriesloom.plans import bindings as b
from seriesloom.plans.bindings import sql
from seriesloom.plans.registry import query
from seriesloom.plans.relational_plans import SCEN_SQL, SHOCKS

r = lambda df, digits, *cols: df.withColumns({c: F.round(c, digits) for c in cols})
METRICS = ["mae", "mape", "mase", "smape", "rmse", "rsq"]


def metrics_sql(by: str) -> str:
    return f"""SELECT {by}, round(avg(abs(y - value)), 4) AS mae, round(100 * avg(CASE WHEN y <> 0 THEN abs((y - value) / y) END), 4) AS mape,
        round(avg(abs(y - value)) / nullif(avg(step), 0), 4) AS mase,
        round(100 * avg(CASE WHEN abs(y) + abs(value) <> 0 THEN 2 * abs(y - value) / (abs(y) + abs(value)) END), 4) AS smape,
        round(sqrt(avg((y - value) * (y - value))), 4) AS rmse,
        CASE WHEN stddev_pop(value) > 1e-6 THEN round(power(corr(y, value), 2), 4) END AS rsq FROM pairs GROUP BY {by}"""


PAIRS = "SELECT id, ds, model_id, model_desc, y, value, abs(y - lag(y) OVER (PARTITION BY id, model_id ORDER BY ds)) AS step FROM fc JOIN fullm USING (id, ds)"


def rounded(acc):
    return r(acc, 4, *METRICS)


def scored(spark, sf):
    return b.baseline_forecasts(spark, sf), b.full_months(spark, sf)


@query("accuracy", sql(metrics_sql("model_id, model_desc"), "fc", pairs=PAIRS))
def accuracy(spark, sf):
    return rounded(ev.accuracy(*scored(spark, sf)))


@query("nested_accuracy", sql(metrics_sql("id, model_id, model_desc"), "fc", pairs=PAIRS))
def nested_accuracy(spark, sf):
    return rounded(ev.nested_accuracy(*scored(spark, sf)))


@query("calibrate", sql("SELECT id, ds, model_id, model_desc, value, y AS actual, round(y - value, 2) AS resid FROM fc JOIN fullm USING (id, ds)", "fc"))
def calibrate(spark, sf):
    return r(ev.calibrate(*scored(spark, sf)), 2, "resid")


@query(
    "test_forecast",
    sql("SELECT id, 0 AS model_id, 'ACTUAL' AS model_desc, 'actual' AS key, ds, y AS value FROM fullm UNION ALL SELECT id, model_id, model_desc, 'prediction', ds, value FROM fc", "fc"),
)
def test_forecast(spark, sf):
    return ev.test_forecast(*scored(spark, sf))


BEST = """SELECT id, arg_min(model_id, rmse) AS model_id FROM (SELECT id, model_id, sqrt(avg((y - value) * (y - value))) AS rmse FROM pairs GROUP BY 1, 2 ORDER BY model_id) GROUP BY id"""


@query("select_best", sql("SELECT fc.id, fc.model_id, model_desc, ds, value FROM fc JOIN best ON best.id = fc.id AND best.model_id = fc.model_id", "fc", pairs=PAIRS, best=BEST))
def select_best(spark, sf):
    f, p = scored(spark, sf)
    return ev.keep_best(f, ev.select_best(ev.nested_accuracy(f, p)))


@query(
    "best_report",
    sql("SELECT acc.* FROM acc JOIN best ON best.id = acc.id AND best.model_id = acc.model_id", "fc", pairs=PAIRS, best=BEST, acc=metrics_sql("id, model_id, model_desc")),
)
def best_report(spark, sf):
    acc = ev.nested_accuracy(*scored(spark, sf))
    return rounded(ev.best_report(acc, ev.select_best(acc)))


@query(
    "best_tally",
    sql("SELECT model_desc, CAST(count(*) AS BIGINT) AS n FROM best JOIN (SELECT DISTINCT model_id, model_desc FROM fc) USING (model_id) GROUP BY 1", "fc", pairs=PAIRS, best=BEST),
)
def best_tally(spark, sf):
    acc = ev.nested_accuracy(*scored(spark, sf))
    return u.count_by(ev.best_report(acc, ev.select_best(acc)), "model_desc")


@query(
    "prediction_interval",
    sql(
        """SELECT id, ds, model_id, model_desc, value, round(value - w, 2) AS lo, round(value + w, 2) AS hi FROM fc
           JOIN (SELECT model_id, quantile_cont(abs(y - value), 0.95) AS w FROM pairs GROUP BY 1) USING (model_id)""",
        "fc",
        pairs=PAIRS,
    ),
)
def prediction_interval(spark, sf):
    f, p = scored(spark, sf)
    return r(ev.with_interval(f, ev.calibrate(f, p)), 2, "lo", "hi")


def blend_sql(value: str, name: str, source: str = "fc") -> str:
    return f"SELECT id, ds, 100 AS model_id, 'ENSEMBLE ({name})' AS model_desc, round({value}, 2) AS value FROM {source} GROUP BY id, ds"


@query("ensemble_mean", sql(blend_sql("CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / 3", "MEAN"), "fc"))
def ensemble_mean(spark, sf):
    return r(bl.ensemble(b.baseline_forecasts(spark, sf)), 2, "value")


@query("ensemble_median", sql(blend_sql("quantile_cont(value, 0.5)", "MEDIAN"), "fc"))
def ensemble_median(spark, sf):
    return r(bl.ensemble(b.baseline_forecasts(spark, sf), "median"), 2, "value")


@query(
    "ensemble_weighted",
    sql(
        blend_sql("sum(rank * value) / sum(rank) + 1e-5", "WEIGHTED", "fc JOIN w USING (model_id)"),
        "fc",
        pairs=PAIRS,
        w="SELECT model_id, rank() OVER (ORDER BY rmse DESC) AS rank FROM (SELECT model_id, sqrt(avg((y - value) * (y - value))) AS rmse FROM pairs GROUP BY 1)",
    ),
)
def ensemble_weighted(spark, sf):
    f, p = scored(spark, sf)
    out = bl.ensemble(f, "weighted", bl.rank_weights(ev.accuracy(f, p)))
    # weights of sixths give exact half cents; both sides move them off the tie
    return out.withColumn("value", F.round(F.col("value") + 1e-5, 2))


@query("ensemble_nested", sql(f"SELECT id, ds, model_id, model_desc, round(value, 2) AS value FROM fc UNION ALL {blend_sql('CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / 3', 'MEAN')}", "fc"))
def ensemble_nested(spark, sf):
    return r(bl.ensemble(b.baseline_forecasts(spark, sf), keep=True), 2, "value")


@query("invert_forecast", sql("SELECT id, ds, model_id, model_desc, round(value, 2) AS value FROM fc", "fc"))
def invert_forecast(spark, sf):
    f, p = scored(spark, sf)
    params = u.scale_params(p)
    z = (F.log1p("value") - F.col("mean_log")) / F.col("sd_log")
    scaled = u.attach_params(f, params).withColumn("value", z).drop("mean_log", "sd_log")
    return r(bl.invert_forecast(scaled, params), 2, "value")


@query("scenario_rates", sql("SELECT * FROM scen", "ratesx", scen=SCEN_SQL))
def scenario_rates(spark, sf):
    return r(bl.scenario_rates(b.rates_ahead(spark, sf), "2001-09-01", SHOCKS), 6, "rate")


# a forecast that reacts to the rate in a known way, so that SQL can follow the scenario flow
RULE = "round(last_y * (1 - rate / 100) + 1e-6, 2)"


def reacting(spark, sf):
    p = b.full_months(spark, sf)
    future = cal.future_frame(p, b.HORIZON, bind=False)
    last = p.groupBy("id").agg(F.max_by("y", "ds").alias("last_y"))
    scen = r(bl.scenario_rates(b.rates_ahead(spark, sf), "2001-09-01", SHOCKS), 6, "rate")
    fanned = u.attach_params(u.attach_scenarios(future, scen), last)
    return p, fanned.select("id", "ds", "scenario", F.expr(RULE).alias("value"))


SC = f"""SELECT id, ds, scenario, {RULE} AS value FROM (SELECT id, CAST(last + to_months(CAST(k AS INTEGER)) AS DATE) AS ds, last_y FROM
    (SELECT id, max(ds) AS last, arg_max(y, ds) AS last_y FROM fullm GROUP BY id), generate_series(1, 12) g(k)) JOIN scen USING (ds)"""


@query("scenario_labels", sql("SELECT * FROM sc UNION ALL SELECT id, ds, 'history', y FROM fullm", "ratesx", scen=SCEN_SQL, sc=SC))
def scenario_labels(spark, sf):
    p, predicted = reacting(spark, sf)
    return bl.scenario_history(predicted, p.withColumnRenamed("y", "value"))


@query(
    "scenario_compare",
    sql(
        f"SELECT id, ds, {', '.join(f'max(CASE WHEN scenario = {chr(39)}{s}{chr(39)} THEN value END) AS {s}' for s in SHOCKS)} FROM sc GROUP BY id, ds",
        "ratesx",
        scen=SCEN_SQL,
        sc=SC,
    ),
)
def scenario_compare(spark, sf):
    return bl.scenario_wide(reacting(spark, sf)[1], list(SHOCKS))


@query(
    "show_best",
    sql(
        """SELECT * FROM (SELECT model_id * 100 + id AS config_id, round(sqrt(avg((y - value) * (y - value))), 4) AS rmse FROM pairs GROUP BY 1) ORDER BY rmse, config_id LIMIT 5""",
        "fc",
        pairs=PAIRS,
    ),
)
def show_best(spark, sf):
    acc = ev.nested_accuracy(*scored(spark, sf))
    results = acc.select((F.col("model_id") * 100 + F.col("id")).alias("config_id"), F.round("rmse", 4).alias("rmse"))
    return ev.show_best(results, "rmse", 5)
