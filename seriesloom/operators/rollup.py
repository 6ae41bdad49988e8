"""Joins to external tables and aggregation of statements into panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.quantiles import exact_quantiles, quantiles_of_counts, value_counts
from seriesloom.operators.cleaning import numeric_columns, with_region


def agg_panel(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sum measures per key, in the precision they have: decimals exactly, doubles as they are.

    Rows meet in the map stage, so a key with most of the rows sends few.
    """
    return df.groupBy(*keys).agg(*[F.sum(m).cast("double").alias(m) for m in measures])


def rollup_region(df: DataFrame, code: str, when: str, measures: Sequence[str] | None = None, region: str = "uf") -> DataFrame:
    """Sum all measures per (region, month). Partial sums stand in for a first pass per municipality."""
    measures = list(measures or [c for c in numeric_columns(df) if c not in (code, when)])
    return agg_panel(with_region(df, code, region), [region, when], measures)


def agg_total(panel: DataFrame, value: str = "y", when: str = "ds") -> DataFrame:
    """National series: the sum over all ids per month."""
    return agg_panel(panel, [when], [value])


def total_forecast(forecast: DataFrame, models: Sequence[str], when: str = "ds", value: str = "value") -> DataFrame:
    """Sum of the chosen model descriptions over all ids per date."""
    return agg_panel(forecast.where(F.col("model_desc").isin(list(models))), [when], [value])


def median_by(df: DataFrame, by: Sequence[str], value: str, out: str = "median") -> DataFrame:
    return exact_quantiles(df, by, value, {out: 0.5}).drop("n")


def scale_params(panel: DataFrame, key: str = "id", value: str = "y") -> DataFrame:
    """Mean and sample deviation of log1p(value) per series, NULLs left out."""
    logged = F.log1p(value)
    return panel.groupBy(key).agg(F.avg(logged).alias("mean_log"), F.stddev_samp(logged).alias("sd_log"))


def range_params(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value of each column, kept to scale other splits and to invert."""
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def distinct_ids(panel: DataFrame, key: str = "id") -> DataFrame:
    return panel.select(key).distinct()


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: counts, mean, deviation and five quantiles."""
    columns = list(columns or numeric_columns(df))
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "column", "value")
    # the table is read once; moments and quantiles come from the counts of its distinct values
    counts = value_counts(long, ["column"], "value")
    moments = counts.groupBy("column").agg(
        F.sum("_c").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_c"))), F.lit(0)).alias("n_missing"),
        (F.sum(F.col("_v") * F.col("_c")) / F.sum(F.when(F.col("_v").isNotNull(), F.col("_c")))).alias("mean"),
    )
    around = counts.join(moments, "column").groupBy("column").agg(F.sum(F.col("_c") * F.pow(F.col("_v") - F.col("mean"), F.lit(2.0))).alias("_s"))
    deviation = F.sqrt(F.col("_s") / F.nullif(F.col("n_rows") - F.col("n_missing") - 1, F.lit(0)))
    quantiles = quantiles_of_counts(counts, ["column"], {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}).drop("n")
    out = moments.join(around, "column", "left").withColumn("sd", deviation).drop("_s")
    return out.join(quantiles, "column", "left")


def attach_exog(panel: DataFrame, rates: DataFrame, on: str = "ds", how: str = "inner") -> DataFrame:
    """Attach external rates by date. No hint: Spark broadcasts the rates only below its size limit."""
    return panel.join(rates, on, how)


def attach_params(frame: DataFrame, params: DataFrame, key: str = "id") -> DataFrame:
    """Join per-series parameters back by id."""
    return frame.join(params, key)


def attach_scenarios(future: DataFrame, scenarios: DataFrame, on: str = "ds") -> DataFrame:
    """Fan future rows out, one per scenario that has a rate for the date."""
    return future.join(scenarios, on)


def future_keys(future: DataFrame, key: str = "id", when: str = "ds", value: str = "y") -> DataFrame:
    """Only key, date and target of a future frame, before known regressors are attached."""
    return future.select(key, when, value)


def uncovered_dates(future: DataFrame, rates: DataFrame, on: str = "ds") -> DataFrame:
    """Dates of the horizon that the rate table does not reach."""
    return future.select(on).distinct().join(rates.select(on), on, "left_anti")


def conditional_sum(value: str, cases: Mapping[str, Column]) -> list[Column]:
    """One sum per named condition, in one pass."""
    return [F.sum(F.when(cond, F.col(value)).otherwise(F.lit(0))).cast("double").alias(name) for name, cond in cases.items()]
