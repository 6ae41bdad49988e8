"""One model over all series: forests and boosted trees on panel features, with recursive forecasts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.columns import fourier_pair, month_index
from seriesloom.operators.features import FeaturePipeline
from seriesloom.operators.series_models import fit_arima, forecast_rows, residual_rows, series_arrays
from seriesloom.session import stage

CALENDAR = ("index_num", "year", "half", "quarter", "month", "sin12_k1", "cos12_k1")


def estimator(kind: str, label: str = "y", **params):
    """Forest or boosted trees by name; parameters carry MLlib's names."""
    base = {"rf": RandomForestRegressor, "gbt": GBTRegressor}[kind]
    return base(labelCol=label, featuresCol="features", **{"seed": 7, **params})


def fit_global(
    train: DataFrame,
    kind: str,
    predictors: Sequence[str],
    nominal: Sequence[str] = (),
    value: str = "y",
    stop: float | None = None,
    **params,
) -> PipelineModel:
    """Preprocessing and trees, fitted on training rows only; rows with an empty predictor are left out by ``complete``.

    With ``stop``, boosting ends early: a tenth of the rows, chosen by a hash of all their values, is held back, and no round
    is added once its error falls by less than this share. ``rounds_used`` tells how many rounds remain.
    """
    train = complete(train, [*predictors, value])
    prepared = FeaturePipeline(predictors, nominal, value).fit(train)
    rows = prepared.transform(train)
    if stop is not None and kind == "gbt":
        rows = rows.withColumn("_held", held_back(train.columns))
        params = {**params, "validationIndicatorCol": "_held", "validationTol": stop}
    model = estimator(kind, value, **params).fit(rows)
    return PipelineModel(stages=[*prepared.stages, model])


def held_back(columns: Sequence[str]) -> Column:
    """A tenth of the rows, chosen by a hash of their values."""
    return F.pmod(F.xxhash64(*columns), F.lit(10)) == 0


def rounds_used(model: PipelineModel) -> int:
    """Trees of the fitted model: fewer than asked for where boosting ended early."""
    return model.stages[-1].getNumTrees


def complete(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value in each of the columns, such as those after a series' first lags."""
    return rows.dropna(subset=list(columns))


def predict(model: PipelineModel, rows: DataFrame, model_id: int, model_desc: str, key: str = "id", when: str = "ds") -> DataFrame:
    """Predictions as a forecast table."""
    return model.transform(rows).select(
        F.col(key).alias("id"), F.lit(model_id).alias("model_id"), F.lit(model_desc).alias("model_desc"), F.col(when).alias("ds"), F.col("prediction").alias("value")
    )


def calendar_columns(day: Column) -> dict[str, Column]:
    sin, cos = fourier_pair(month_index(day), 12, 1)
    return {
        "index_num": F.unix_date(day).cast("bigint"),
        "year": F.year(day),
        "half": F.when(F.month(day) <= 6, 1).otherwise(2),
        "quarter": F.quarter(day),
        "month": F.month(day),
        "sin12_k1": sin,
        "cos12_k1": cos,
    }


def recursive_forecast(
    model: PipelineModel,
    history: DataFrame,
    h: int,
    lags: Sequence[int] = range(1, 7),
    roll_lag: int = 6,
    periods: Sequence[int] = (),
    key: str = "id",
    when: str = "ds",
    value: str = "y",
    status: bool = False,
) -> DataFrame:
    """Forecast h steps for all series together; each step sees the predictions before it.

    A series is one row with the last values that lags and rolling means reach, so a step is a projection without a
    shuffle. The lineage is cut every few steps. With ``status``, series that are too short for the lags get a row of
    their own that says so, instead of h rows with the status ``ok``; without it they raise an error.
    """
    reach = [roll_lag + (n - 1) // 2 for n in periods]
    memory, least = max([1, *lags, *reach]), max([1, *lags, *[roll_lag - (n - (n - 1) // 2 - 1) for n in periods]])
    ordered = F.array_sort(F.collect_list(F.struct(F.col(when).alias("t"), F.col(value).alias("v"))))
    state = history.groupBy(key).agg(ordered.alias("_p")).select(
        key, F.element_at("_p", -1)["t"].alias("_last"), F.slice("_p", -F.least(F.size("_p"), F.lit(memory)), memory)["v"].alias("_h")
    )
    state = stage(state)
    short = state.where(F.size("_h") < least).select(key, F.size("_h").alias("_n"))
    if not status and (first := short.first()) is not None:
        raise ValueError(f"series {first[0]} has {first[1]} months; the lags need {least}")
    state = state.where(F.size("_h") >= least)
    past = lambda k: F.try_element_at("_h", F.lit(-k))
    keep = state.columns
    for step in range(1, h + 1):
        day = F.add_months("_last", step)
        columns = {name: col for name, col in calendar_columns(day).items()}
        columns.update({f"{value}_lag{k}": past(k) for k in lags})
        for n in periods:
            back = (n - 1) // 2
            cells = F.array_compact(F.array(*[past(roll_lag - offset) for offset in range(-back, n - back)]))
            columns[f"{value}_lag{roll_lag}_roll{n}"] = F.try_divide(F.aggregate(cells, F.lit(0.0), lambda s, v: s + v), F.size(cells))
        scored = model.transform(state.withColumns(columns))
        state = scored.withColumn("_h", F.concat("_h", F.array("prediction"))).select(*keep)
        if step % 4 == 0 and step < h:
            state = stage(state)
    rows = state.select(key, "_last", F.posexplode(F.slice("_h", -h, h)).alias("_k", "value")).select(
        F.col(key).alias("id"), F.add_months("_last", F.col("_k") + 1).alias("ds"), "value"
    )
    if not status:
        return rows
    why = short.select(F.col(key).alias("id"), F.concat_ws(" ", F.lit("too short:"), "_n", F.lit(f"of {least} months")).alias("status"))
    return rows.withColumn("status", F.lit("ok")).unionByName(why, allowMissingColumns=True)


def with_calendar(rows: DataFrame) -> DataFrame:
    return rows.withColumns(calendar_columns(F.col("ds")))


def boost_errors(fits: DataFrame, learn: DataFrame, ahead: DataFrame, predictors: Sequence[str], nominal: Sequence[str] = (), **params) -> tuple[PipelineModel, DataFrame]:
    """Boosted trees over all series on the errors that per-series fits leave, and the forecasts with what the trees add.

    ``learn`` (id, ds, predictors) has the features of the history, ``ahead`` those of the horizon.
    """
    errors = residual_rows(fits).join(learn, ["id", "ds"])
    boost = fit_global(errors, "gbt", predictors, nominal, "resid", **params)
    base = complete(forecast_rows(fits).join(ahead, ["id", "ds"]), predictors)
    combined = boost.transform(base).select(
        "id", F.lit(5).alias("model_id"), F.lit("ARIMA W/ BOOSTED ERRORS").alias("model_desc"), "ds", (F.col("value") + F.col("prediction")).alias("value")
    )
    return boost, combined


def fit_arima_boost(
    train: DataFrame,
    h: int,
    nominal: Sequence[str] = (),
    regressors: Sequence[str] = (),
    future: DataFrame | None = None,
    m: int = 12,
    features: tuple[DataFrame, DataFrame] | None = None,
    predictors: Sequence[str] = CALENDAR,
    **params,
) -> tuple[DataFrame, PipelineModel, DataFrame]:
    """ARIMA per series, then boosted trees over all series on the errors it leaves.

    ``features`` are the rows (id, ds, predictors) of the history and of the horizon, with lags, rolling means or
    regressors; without them the trees see the calendar. Returns the ARIMA fits, the tree pipeline and the combined forecast.
    """
    fits = stage(fit_arima(series_arrays(train, regressors, future), h, m))
    if features is None:
        features = tuple(with_calendar(f.select("id", "ds")) for f in (residual_rows(fits), forecast_rows(fits)))
    boost, combined = boost_errors(fits, *[f.select("id", "ds", *predictors) for f in features], predictors, nominal, **params)
    return fits, boost, combined


def registry(train: DataFrame, models: Mapping[str, object]) -> DataFrame:
    """Number the fitted models and note what they are, their trees and the training rows they saw (a handful of rows)."""
    n = train.count()
    rows = [(i, desc, type(m.stages[-1]).__name__, rounds_used(m), n) for i, (desc, m) in enumerate(models.items(), 1)]
    return train.sparkSession.createDataFrame(rows, "model_id int, model_desc string, engine string, trees int, n_rows bigint")
