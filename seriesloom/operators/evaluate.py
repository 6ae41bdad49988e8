"""Accuracy, selection and intervals. Forecast tables are long: id, model_id, model_desc, ds, value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.quantiles import array_quantile, exact_quantiles


def accuracy(
    forecast: DataFrame,
    panel: DataFrame,
    by: Sequence[str] = ("model_id", "model_desc"),
    key: str = "id",
    when: str = "ds",
    value: str = "y",
) -> DataFrame:
    """MAE, MAPE, MASE, SMAPE, RMSE and R squared per group of forecast rows.

    MASE is scaled by the one-step changes of the evaluated rows, taken inside each series.
    """
    actual = panel.select(key, when, F.col(value).alias("_y"))
    rows = forecast.join(actual, [key, when])
    order = Window.partitionBy(key, "model_id").orderBy(when)
    rows = rows.withColumn("_step", F.abs(F.col("_y") - F.lag("_y").over(order)))
    e, y, f = F.col("_y") - F.col("value"), F.col("_y"), F.col("value")
    both = F.abs(y) + F.abs(f)
    mae = F.avg(F.abs(e))
    return rows.groupBy(*by).agg(
        mae.alias("mae"),
        (100 * F.avg(F.when(y != 0, F.abs(e / y)))).alias("mape"),
        (mae / F.nullif(F.avg("_step"), F.lit(0.0))).alias("mase"),
        (100 * F.avg(F.when(both != 0, 2 * F.abs(e) / both))).alias("smape"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        # written out, since corr fails on a constant forecast
        (
            F.pow(F.covar_pop(y, f), F.lit(2.0)) / F.nullif(F.var_pop(y) * F.var_pop(f), F.lit(0.0))
        ).alias("rsq"),
    )


def nested_accuracy(forecast: DataFrame, panel: DataFrame, key: str = "id", **kw) -> DataFrame:
    """Accuracy per series and model."""
    return accuracy(forecast, panel, (key, "model_id", "model_desc"), key, **kw)


def calibrate(forecast: DataFrame, panel: DataFrame, key: str = "id", when: str = "ds", value: str = "y") -> DataFrame:
    """Hold-out predictions with actual and residual, kept for accuracy and intervals."""
    actual = panel.select(key, when, F.col(value).alias("actual"))
    return forecast.join(actual, [key, when]).withColumn("resid", F.col("actual") - F.col("value"))


def actual_rows(panel: DataFrame, key: str = "id", when: str = "ds", value: str = "y") -> DataFrame:
    return panel.select(
        key,
        F.lit(0).alias("model_id"),
        F.lit("ACTUAL").alias("model_desc"),
        F.lit("actual").alias("key"),
        F.col(when),
        F.col(value).alias("value"),
    )


def test_forecast(forecast: DataFrame, panel: DataFrame, key: str = "id", when: str = "ds", value: str = "y") -> DataFrame:
    """Actual rows and prediction rows in one long table."""
    predicted = forecast.select(key, "model_id", "model_desc", F.lit("prediction").alias("key"), when, "value")
    return actual_rows(panel, key, when, value).unionByName(predicted)


def select_best(accuracy_table: DataFrame, metric: str = "rmse", key: str = "id", minimize: bool = True) -> DataFrame:
    """The best model of each series; on equal metrics the lower model id wins."""
    score = F.col(metric) if minimize else -F.col(metric)
    usable = accuracy_table.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    return usable.groupBy(key).agg(F.min_by("model_id", F.struct(score, "model_id")).alias("model_id"))


def keep_best(forecast: DataFrame, best: DataFrame, key: str = "id") -> DataFrame:
    """Only the forecast rows of each series' best model."""
    return forecast.join(best.select(key, "model_id"), [key, "model_id"], "left_semi")


def best_report(accuracy_table: DataFrame, best: DataFrame, key: str = "id") -> DataFrame:
    """Winner of each series with its metrics."""
    return keep_best(accuracy_table, best, key)


def with_interval(
    forecast: DataFrame, calibration: DataFrame, level: float = 0.95, by: Sequence[str] = ("model_id",)
) -> DataFrame:
    """Limits at plus and minus the residual quantile of the hold-out, per model or per series and model.

    With ``id`` among the columns a group has no more rows than the hold-out has months, and is sorted as an array.
    """
    size = calibration.select(*by, F.abs("resid").alias("_e"))
    if "id" in by:
        width = size.groupBy(*by).agg(F.collect_list("_e").alias("_e")).select(*by, array_quantile(F.col("_e"), level).alias("_w"))
    else:
        width = exact_quantiles(size, by, "_e", {"_w": level}).drop("n")
    out = forecast.join(width, list(by), "left")
    return out.withColumn("lo", F.col("value") - F.col("_w")).withColumn("hi", F.col("value") + F.col("_w")).drop("_w")


def show_best(results: DataFrame, metric: str = "rmse", n: int = 5) -> DataFrame:
    """The n best configurations of a tuning table."""
    order = F.desc(metric) if metric == "rsq" else F.asc(metric)
    return results.orderBy(order, "config_id").limit(n)
