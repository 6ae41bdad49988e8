"""Ensembles, inversion of transforms, scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.ordered import rank_models


def ensemble(
    forecast: DataFrame,
    how: str = "mean",
    weights: DataFrame | None = None,
    model_id: int = 100,
    keys: Sequence[str] = ("id", "ds"),
    keep: bool = False,
) -> DataFrame:
    """Combine the models' values per series and date.

    ``how`` is mean, median or weighted (``weights``: model_id, weight). Models that lack a row
    are left out of it and the weights of the others are scaled up. With ``keep`` the single
    models stay as candidates.
    """
    rows = forecast
    if how == "weighted":
        rows = forecast.join(weights.select("model_id", "weight"), "model_id")
        value = F.sum(F.col("weight") * F.col("value")) / F.sum("weight")
    elif how == "median":
        # one value per model, so the group is bounded by the number of models
        value = F.median("value")
    else:
        value = F.avg("value")
    label = f"ENSEMBLE ({how.upper()})"
    blended = rows.groupBy(*keys).agg(value.alias("value")).select(
        *keys, F.lit(model_id).alias("model_id"), F.lit(label).alias("model_desc"), "value"
    )
    if not keep:
        return blended
    return forecast.select(*keys, "model_id", "model_desc", "value").unionByName(blended)


def rank_weights(accuracy: DataFrame, metric: str = "rmse") -> DataFrame:
    """Weights from ranks: the worst model has rank 1, the best the largest weight."""
    ranked = rank_models(accuracy, metric)
    whole = ranked.agg(F.sum("rank")).scalar()
    return ranked.select("model_id", "rank", (F.col("rank") / whole).alias("weight"))


def invert_forecast(forecast: DataFrame, params: DataFrame, key: str = "id", value: str = "value") -> DataFrame:
    """Undo the z-score and the log1p of each series by its own parameters."""
    raw = F.expm1(F.col(value) * F.col("sd_log") + F.col("mean_log"))
    return forecast.join(params, key).withColumn(value, raw).drop("mean_log", "sd_log")


def scenario_rates(rates: DataFrame, cutoff: str, shocks: dict[str, float], column: str = "rate", when: str = "ds") -> DataFrame:
    """One labelled copy of the rates per scenario, shifted after the cutoff."""
    table = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(s)).alias("_shock")) for n, s in shocks.items()])
    fanned = rates.select("*", F.inline(table))
    after = F.col(when) > F.lit(cutoff).cast("date")
    return fanned.withColumn(column, F.when(after, F.col(column) + F.col("_shock")).otherwise(F.col(column))).drop("_shock")


def scenario_history(predicted: DataFrame, history: DataFrame, label: str = "history") -> DataFrame:
    """Scenario predictions with the actual rows under their own label."""
    return predicted.unionByName(history.withColumn("scenario", F.lit(label)), allowMissingColumns=True)


def scenario_wide(forecast: DataFrame, scenarios: Sequence[str], keys: Sequence[str] = ("id", "ds")) -> DataFrame:
    """Scenario values side by side."""
    return forecast.groupBy(*keys).pivot("scenario", list(scenarios)).agg(F.first("value"))
