"""Stacking, pivoting and nesting of panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_rows(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def combine_models(*registries: DataFrame) -> DataFrame:
    """Stack model tables and number them anew in their given order (a handful of rows)."""
    placed = [r.withColumn("_table", F.lit(i)) for i, r in enumerate(registries)]
    order = Window.partitionBy(F.lit(1)).orderBy("_table", "model_id")
    return union_rows(*placed).withColumn("_new", F.row_number().over(order)).withColumn("model_id", F.col("_new")).drop("_new", "_table")


def pivot_wide(panel: DataFrame, index: str, columns: str, values: Sequence, value: str = "y", prefix: str = "") -> DataFrame:
    """Long to wide for a given, short list of column values."""
    wide = panel.groupBy(index).pivot(columns, list(values)).agg(F.first(value, ignorenulls=True))
    return wide.toDF(index, *[f"{prefix}{v}" for v in values])


def melt_long(df: DataFrame, index: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(index), list(values), name, value)


def to_arrays(panel: DataFrame, key: str = "id", when: str = "ds", value: str = "y", dates: bool = False) -> DataFrame:
    """One row per series with its values in date order.

    The array is bounded by the calendar, since a panel has one row per series and period.
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.col(when).alias("t"), F.col(value).alias("v"))))
    nested = panel.groupBy(key).agg(pairs.alias("_p"))
    extra = [F.col("_p.t").alias(when)] if dates else []
    return nested.select(key, *extra, F.col("_p.v").alias("a"))


def from_arrays(arrays: DataFrame, key: str = "id", when: str = "ds", value: str = "y") -> DataFrame:
    """Back to one row per series and date; needs the dates next to the values."""
    zipped = F.arrays_zip(F.col(when).alias("t"), F.col("a").alias("v"))
    return arrays.select(key, F.inline(zipped).alias(when, value))
