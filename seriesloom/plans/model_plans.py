"""Queries that fit models: per series, over all series, tuned and explained."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import blend as bl
from seriesloom.operators import calendar as cal
from seriesloom.operators import evaluate as ev
from seriesloom.operators import explain as ex
from seriesloom.operators import features as ft
from seriesloom.operators import global_models as gm
from seriesloom.operators import rollup as u
from seriesloom.operators import series_models as sm
from seriesloom.operators import tuning as tn
from seriesloom.plans import bindings as b
from seriesloom.plans.bindings import HOLDOUT, HORIZON, sql
from seriesloom.plans.feature_plans import model_features
from seriesloom.plans.registry import query
from seriesloom.plans.relational_plans import SHOCKS, W
from seriesloom.session import shared_folder, stage
from seriesloom.sources import panels

r = lambda df, digits, *cols: df.withColumns({c: F.round(c, digits) for c in cols})


def split_panel(spark, sf):
    return stage(cal.split_last_n(b.full_months(spark, sf), HOLDOUT))


def train_arrays(panel):
    return sm.series_arrays(panel.where("split = 'train'"))


# per series


def fitted(fits):
    return fits.select("id", "model_id", "model_desc", "form", F.round("aicc", 4).alias("aicc"), F.array_join(F.transform("ahead", lambda v: F.round(v, 2).cast("string")), " ").alias("ahead"))


@query("fit_trend_season")
def fit_trend_season(spark, sf):
    return fitted(sm.fit_trend_season(train_arrays(split_panel(spark, sf)), HOLDOUT))


@query("fit_trend_season_xreg")
def fit_trend_season_xreg(spark, sf):
    p = stage(cal.split_last_n(u.attach_exog(b.full_months(spark, sf), b.rates(spark, sf)), HOLDOUT))
    arrays = sm.series_arrays(p.where("split = 'train'"), ["rate"], p.where("split = 'test'"))
    return fitted(sm.fit_trend_season(arrays, HOLDOUT))


@query("fit_arima")
def fit_arima(spark, sf):
    return fitted(sm.fit_arima(train_arrays(split_panel(spark, sf)), HOLDOUT))


@query("fit_arima_xreg")
def fit_arima_xreg(spark, sf):
    p = stage(cal.split_last_n(u.attach_exog(b.full_months(spark, sf), b.rates(spark, sf)), HOLDOUT))
    arrays = sm.series_arrays(p.where("split = 'train'"), ["rate"], p.where("split = 'test'"))
    return fitted(sm.fit_arima(arrays, HOLDOUT))


@query("fit_ets")
def fit_ets(spark, sf):
    return fitted(sm.fit_ets(train_arrays(split_panel(spark, sf)), HOLDOUT))


FIXED = """SELECT id, alpha, round(l, 2) AS level, round(b, 4) AS slope, round(sse / 1e6, 2) AS sse FROM run JOIN
    (SELECT id, max(t) AS last FROM numbered GROUP BY id) e USING (id) WHERE run.t = e.last"""


def fold_sql(slope0: str, beta: str) -> str:
    return sql(
        FIXED,
        "fullm",
        recursive=True,
        numbered=f"SELECT id, y, lead(y) OVER ({W}) AS y2, row_number() OVER ({W}) AS t FROM fullm",
        run=f"""SELECT id, a AS alpha, t, y AS l, {slope0} AS b, CAST(0 AS DOUBLE) AS sse FROM numbered, (VALUES (CAST(0.2 AS DOUBLE)), (0.5), (0.8)) g(a) WHERE t = 1
            UNION ALL SELECT r.id, r.alpha, n.t, r.l + r.b + r.alpha * (n.y - r.l - r.b), r.b + {beta} * (n.y - r.l - r.b),
            r.sse + (n.y - r.l - r.b) * (n.y - r.l - r.b) FROM run r JOIN numbered n ON n.id = r.id AND n.t = r.t + 1""",
    )


def folded(df):
    return r(r(df.withColumn("sse", F.col("sse") / 1e6), 2, "level", "sse"), 4, "slope")


@query("fit_ets_fixed", fold_sql("CAST(0 AS DOUBLE)", "0"))
def fit_ets_fixed(spark, sf):
    return folded(sm.smooth_fixed(b.full_months(spark, sf), (0.2, 0.5, 0.8)))


@query("fit_holt_fixed", fold_sql("y2 - y", "CAST(0.1 AS DOUBLE)"))
def fit_holt_fixed(spark, sf):
    return folded(sm.smooth_fixed(b.full_months(spark, sf), (0.2, 0.5, 0.8), beta=0.1))


@query("fit_tbats")
def fit_tbats(spark, sf):
    return fitted(sm.fit_tbats(train_arrays(split_panel(spark, sf)), HOLDOUT))


@query("nested_fit")
def nested_fit(spark, sf):
    p = split_panel(spark, sf)
    return r(sm.forecast_rows(sm.nested_fit(train_arrays(p), h=HOLDOUT)), 2, "value")


@query("nested_fit_accuracy")
def nested_fit_accuracy(spark, sf):
    p = split_panel(spark, sf)
    f = sm.forecast_rows(sm.nested_fit(train_arrays(p), h=HOLDOUT))
    return r(ev.nested_accuracy(f, p), 4, "mae", "mape", "mase", "smape", "rmse", "rsq")


GAPS_SQL = "'ValueError: ' || (n_span - n_months) || ' months have no value; pad or interpolate the series first'"


@query(
    "error_report",
    f"""WITH m AS (SELECT o_custkey, count(DISTINCT date_trunc('month', o_orderdate)) AS n_months, date_diff('month', min(o_orderdate), max(o_orderdate)) + 1 AS n_span FROM orders GROUP BY 1),
       e AS (SELECT model_desc, CASE WHEN n_months = 1 THEN 'ValueError: series too short' ELSE {GAPS_SQL} END AS message
         FROM m, (VALUES ('TREND-SEASON'), ('ARIMA'), ('ETS')) v(model_desc) WHERE (n_months = 1 AND model_desc <> 'ETS') OR (n_span > n_months AND model_desc <> 'ARIMA'))
       SELECT model_desc, message, CAST(count(*) AS BIGINT) AS n_series FROM e GROUP BY 1, 2""",
)
def error_report(spark, sf):
    """Customers as series, not padded: which models fail, and why.

    A single month is too short for trend-season and ARIMA; ETS takes it. Gaps stop trend-season and ETS; ARIMA fits them,
    at some tenths of a second each, so it is only asked for the single months here.
    """
    months = b.order_months(spark, sf).select(F.col("o_custkey").alias("id"), "ds", F.col("y").cast("double").alias("y"))
    arrays = stage(sm.series_arrays(months))
    single = F.size("y") == 1
    odd = arrays.where(single | F.exists("y", lambda v: v.isNull()))
    fits = sm.nested_fit(odd, ("trend_season", "ets"), HORIZON).unionByName(sm.nested_fit(arrays.where(single), ("arima",), HORIZON))
    return sm.error_report(fits).groupBy("model_desc", "message").agg(F.count(F.lit(1)).alias("n_series"))


@query("customer_forecast")
def customer_forecast(spark, sf):
    """Every customer as a series on a full calendar: the axis that grows with the data."""
    months = stage(b.order_months(spark, sf).select(F.col("o_custkey").alias("id"), "ds", F.col("y").cast("double").alias("y")))
    fits = sm.fit_trend_season(sm.series_arrays(cal.pad_calendar(months)), HORIZON)
    return r(sm.forecast_rows(fits), 2, "value")


def tournament(spark, sf, models=("trend_season", "arima", "ets"), blend=False):
    """Hold-out fit, accuracy and winner per series."""
    p = split_panel(spark, sf)
    fits = stage(sm.nested_fit(train_arrays(p), models, HOLDOUT))
    f = sm.forecast_rows(fits)
    if blend:
        f = bl.ensemble(f, keep=True)
    acc = ev.nested_accuracy(f, p)
    return p, fits, f, acc, stage(ev.select_best(acc))


@query("refit")
def refit(spark, sf):
    p, _, _, _, best = tournament(spark, sf)
    return fitted(sm.nested_fit(sm.series_arrays(p), h=HORIZON, chosen=best))


def best_ahead(p, f, best):
    """The winners refitted on all months and forecast with limits, after the actual rows."""
    calibration = ev.keep_best(ev.calibrate(f, p), best)
    future = sm.forecast_rows(sm.nested_fit(sm.series_arrays(p), h=HORIZON, chosen=best))
    bounded = ev.with_interval(future, calibration, by=("id", "model_id"))
    out = ev.actual_rows(p).unionByName(bounded.withColumn("key", F.lit("prediction")), allowMissingColumns=True)
    return r(out, 2, "value", "lo", "hi")


@query("nested_forecast")
def nested_forecast(spark, sf):
    """Fit three models per series, keep the best on the hold-out, refit it and forecast a year with limits."""
    p, _, f, _, best = tournament(spark, sf)
    return best_ahead(p, f, best)


@query("nested_ensemble_flow")
def nested_ensemble_flow(spark, sf):
    """The same with the mean of the three models as a candidate: selected again, refitted by its members, forecast."""
    p, _, f, _, best = tournament(spark, sf, blend=True)
    return best_ahead(p, f, best)


@query("future_forecast")
def future_forecast(spark, sf):
    """All models and their mean as candidates, refitted and forecast with limits, actual rows and the input columns."""
    p, _, f, _, _ = tournament(spark, sf, blend=True)
    future = bl.ensemble(sm.forecast_rows(stage(sm.nested_fit(sm.series_arrays(p), h=HORIZON))), keep=True)
    bounded = ev.with_interval(future, ev.calibrate(f, p), by=("id", "model_id")).withColumn("key", F.lit("prediction"))
    both = ev.actual_rows(p).unionByName(bounded, allowMissingColumns=True)
    kept = u.attach_exog(both, b.rates_ahead(spark, sf), how="left")
    return r(kept.select("id", "ds", "model_id", "model_desc", "key", "value", "lo", "hi", "rate"), 2, "value", "lo", "hi")


@query("scenario_forecast")
def scenario_forecast(spark, sf):
    """Four families once per scenario of the future rates, over the whole horizon, with the history.

    Trend-season and ARIMA have the rate as regressor, ETS has none, and the trees on ARIMA's errors see it with the calendar.
    """
    p = stage(u.attach_exog(b.full_months(spark, sf), b.rates(spark, sf)).select("id", "ds", "y", "rate"))
    scen = bl.scenario_rates(b.rates_ahead(spark, sf), "2001-09-01", SHOCKS)
    future = stage(u.attach_scenarios(cal.future_frame(p.select("id", "ds", "y"), HORIZON, bind=False), scen))
    # each (series, scenario) is one row to fit, known by a joint key
    names = F.array(*[F.lit(s) for s in SHOCKS])
    joint = F.concat_ws("|", "id", "scenario").alias("key")
    history = p.withColumn("scenario", F.explode(names)).select("*", joint)
    ahead = future.select("*", joint)
    arrays = stage(sm.series_arrays(history, ["rate"], ahead, key="key", h=HORIZON))
    fits = stage(sm.nested_fit(arrays, h=HORIZON))
    features = [gm.with_calendar(f.select(F.col("key").alias("id"), "ds", "rate")) for f in (history, ahead)]
    _, boosted = gm.boost_errors(fits.where("model_id = 2"), *features, [*gm.CALENDAR, "rate"], **FULL["gbt"])
    rows = sm.forecast_rows(fits).unionByName(boosted)
    parts = F.split("id", "\\|")
    labelled = rows.select(parts[0].cast("int").alias("id"), "ds", "model_desc", parts[1].alias("scenario"), F.round("value", 2).alias("value"))
    return bl.scenario_history(labelled, p.select("id", "ds", F.lit("ACTUAL").alias("model_desc"), F.round("y", 2).alias("value")))


# over all series

LAGS = [f"y_lag{k}" for k in range(1, 7)]
ROLLS = [f"y_lag6_roll{k}" for k in range(1, 7)]
PREDICTORS = [*gm.CALENDAR, *LAGS, *ROLLS]
# The usual defaults of the engines, a forest of 500 trees that try the root of the features at each split, and
# 15 rounds of depth 6 at rate 0.3
FULL = {"rf": {"numTrees": 500, "maxDepth": 10, "minInstancesPerNode": 5, "featureSubsetStrategy": "sqrt"}, "gbt": {"maxIter": 15, "maxDepth": 6, "stepSize": 0.3}}


def prepared(spark, sf):
    """Feature rows of the known months with their split, written once."""
    f = model_features(spark, sf).where("y IS NOT NULL")
    # the first months of a series have no lags yet
    return stage(gm.complete(ft_split(f).select("id", "ds", "y", "split", *PREDICTORS), PREDICTORS))


def ft_split(f):
    return cal.split_last_n(f, HOLDOUT)


def holdout(spark, sf, kind):
    f = prepared(spark, sf)
    model = gm.fit_global(f.where("split = 'train'"), kind, PREDICTORS, ["id"], **FULL[kind])
    return f, model


@query("fit_random_forest")
def fit_random_forest(spark, sf):
    f, model = holdout(spark, sf, "rf")
    return r(gm.predict(model, f.where("split = 'test'"), 1, "RANDOM FOREST"), 6, "value")


@query("fit_boosted_trees")
def fit_boosted_trees(spark, sf):
    f, model = holdout(spark, sf, "gbt")
    return r(gm.predict(model, f.where("split = 'test'"), 2, "BOOSTED TREES"), 6, "value")


@query("fit_arima_boost")
def fit_arima_boost(spark, sf):
    p = split_panel(spark, sf)
    f = prepared(spark, sf).drop("y", "split")
    _, _, combined = gm.fit_arima_boost(p.where("split = 'train'"), HOLDOUT, ["id"], features=(f, f), predictors=PREDICTORS, **FULL["gbt"])
    return r(combined, 2, "value")


@query("global_forecast")
def global_forecast(spark, sf):
    """Recursive year ahead in original units: predict scaled values, then invert per series."""
    f = prepared(spark, sf)
    model = gm.fit_global(f, "rf", PREDICTORS, ["id"], **FULL["rf"])
    ahead = gm.recursive_forecast(model, f.select("id", "ds", "y"), HORIZON, periods=range(1, 7))
    train = cal.split_last_n(ft.transform(b.full_months(spark, sf), "log1p"), HOLDOUT).where("split = 'train'")
    params = train.groupBy("id").agg(F.avg("y").alias("mean_log"), F.stddev_samp("y").alias("sd_log"))
    return r(bl.invert_forecast(ahead, params), 2, "value")


@query("global_flow")
def global_flow(spark, sf):
    """Three global models on a hold-out, their ensembles, inversion to original units, national totals per model."""
    f = prepared(spark, sf)
    train, test = f.where("split = 'train'"), f.where("split = 'test'")
    rf = gm.predict(gm.fit_global(train, "rf", PREDICTORS, ["id"], **FULL["rf"]), test, 1, "RANDOM FOREST")
    gbt = gm.predict(gm.fit_global(train, "gbt", PREDICTORS, ["id"], **FULL["gbt"]), test, 2, "BOOSTED TREES")
    _, _, boosted = gm.fit_arima_boost(train.select("id", "ds", "y"), HOLDOUT, ["id"], features=(train.drop("y"), test.drop("y")), predictors=PREDICTORS, **FULL["gbt"])
    single = stage(rf.unionByName(gbt).unionByName(boosted))
    weights = bl.rank_weights(ev.accuracy(single, f))
    blends = [
        bl.ensemble(single, "mean", model_id=101),
        bl.ensemble(single, "median", model_id=102),
        bl.ensemble(single, "weighted", weights, model_id=103),
    ]
    table = single
    for one in blends:
        table = table.unionByName(one)
    logged = cal.split_last_n(ft.transform(b.full_months(spark, sf), "log1p"), HOLDOUT).where("split = 'train'")
    params = logged.groupBy("id").agg(F.avg("y").alias("mean_log"), F.stddev_samp("y").alias("sd_log"))
    original = bl.invert_forecast(table, params)
    return r(original.groupBy("model_id", "model_desc", "ds").agg(F.sum("value").alias("value")), 2, "value")


@query(
    "model_registry",
    sql(
        """SELECT model_id, model_desc, engine, trees, CAST((SELECT count(*) FROM (SELECT row_number() OVER (PARTITION BY id ORDER BY ds) AS t FROM split WHERE split = 'train') WHERE t > 6) AS BIGINT) AS n_rows
           FROM (VALUES (1, 'RANDOM FOREST', 'RandomForestRegressionModel', 500), (2, 'BOOSTED TREES', 'GBTRegressionModel', 15)) v(model_id, model_desc, engine, trees)""",
        "split",
    ),
)
def model_registry(spark, sf):
    f = prepared(spark, sf)
    train = f.where("split = 'train'")
    models = {"RANDOM FOREST": gm.fit_global(train, "rf", PREDICTORS, ["id"], **FULL["rf"]), "BOOSTED TREES": gm.fit_global(train, "gbt", PREDICTORS, ["id"], **FULL["gbt"])}
    return gm.registry(train, models)


@query("sink_models")
def sink_models(spark, sf):
    """Save two pipelines, load them and predict with the loaded ones."""
    f = prepared(spark, sf)
    train = f.where("split = 'train'")
    models = {k: gm.fit_global(train, k, PREDICTORS, ["id"], **FULL[k]) for k in FULL}
    path = shared_folder(spark)
    panels.save_models(spark, path, models, {k: FULL[k] for k in FULL})
    loaded = panels.load_models(spark, path)
    rows = [gm.predict(m, f.where("split = 'test'"), i, name) for i, (name, m) in enumerate(loaded.items(), 1)]
    return r(rows[0].unionByName(rows[1]), 6, "value")


# tuning and explanation


@query("param_grid")
def param_grid(spark, sf):
    """A design whose upper bounds come from the panel: its series, months and features."""
    p = b.full_months(spark, sf)
    size = p.agg(F.count_distinct("id").alias("ids"), F.count_distinct("ds").alias("months")).first()
    ranges = {"mtry": (1, len(PREDICTORS)), "minInstancesPerNode": (size["ids"], 2), "numTrees": (10, size["months"]), "stepSize": (-1, -2)}
    return r(tn.latin_hypercube(spark, ranges, 20, seed=320), 6, *ranges)


RANGES = {"rf": {"mtry": (2, 12), "minInstancesPerNode": (2, 20)}, "gbt": {"minInstancesPerNode": (30, 2), "stepSize": (-0.3, -1.5)}}


@query("tune")
def tune(spark, sf):
    f = prepared(spark, sf).where("split = 'train'")
    folds = cal.time_folds(f, 3)
    grid = tn.latin_hypercube(spark, RANGES["rf"], 4, seed=1)
    out = tn.tune(folds, "rf", grid, PREDICTORS, ["id"], fixed={"numTrees": 50, "maxDepth": 8})
    return r(out, 6, "rmse", "rmse_se", "rsq")


def rounds(spark, sf):
    """Three narrowing rounds for boosted trees with early stopping, their scores logged as they come."""
    train = cal.kfold(prepared(spark, sf).where("split = 'train'"), 2, seed=262)
    options = {"points": (3, 2, 1), "top": 2, "fixed": {"maxIter": 15, "maxDepth": 4}, "log": shared_folder(spark), "stop": 0.01}
    return train, tn.tune_rounds(train, "gbt", RANGES["gbt"], PREDICTORS, ["id"], **options)


@query("tune_rounds")
def tune_rounds(spark, sf):
    return r(rounds(spark, sf)[1], 6, "rmse", "rmse_se", "rsq", *RANGES["gbt"])


@query("finalize")
def finalize(spark, sf):
    """The best configuration of all rounds, fitted on all training rows, on the hold-out."""
    train, found = rounds(spark, sf)
    final = tn.finalize(train, "gbt", found, PREDICTORS, ["id"], metric="rsq", fixed={"maxIter": 15, "maxDepth": 4})
    return r(gm.predict(final, prepared(spark, sf).where("split = 'test'"), 1, "BOOSTED TREES - tuned"), 6, "value")


@query("feature_importance")
def feature_importance(spark, sf):
    f, model = holdout(spark, sf, "gbt")
    return r(ex.feature_importance(model, f), 6, "importance")


@query("permutation_importance")
def permutation_importance(spark, sf):
    f, model = holdout(spark, sf, "gbt")
    return r(ex.permutation_importance(model, f.where("split = 'test'"), PREDICTORS), 6, "rmse", "ratio")


@query("partial_dependence")
def partial_dependence(spark, sf):
    f, model = holdout(spark, sf, "gbt")
    return r(ex.partial_dependence(model, f, "month", list(range(1, 13))), 6, "mean_prediction")


@query("local_surrogate")
def local_surrogate(spark, sf):
    f, model = holdout(spark, sf, "gbt")
    test = f.where("split = 'test'")
    return r(ex.local_surrogate(model, test, f.where("split = 'train'"), LAGS + ["sin12_k1", "cos12_k1"]), 6, "effect", "intercept")
