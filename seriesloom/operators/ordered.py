"""Operators over the order of rows: first and last, top-k, lags, rolling means, interpolation.

Windows are partitioned by series and run on panels, so a window holds at most one row per
calendar period. Where the input is raw rows, an aggregate takes the place of the window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.session import stage


def _edge_per_period(df: DataFrame, period: Column, when: str, keys: Sequence[str], pick) -> DataFrame:
    marked = df.withColumn("period", period)
    edge = marked.groupBy(*keys, "period").agg(pick(when).alias(when))
    return marked.join(edge, [*keys, "period", when], "left_semi")


def first_in_period(df: DataFrame, period: Column, when: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Rows at the earliest time of each period, ties kept."""
    return _edge_per_period(df, period, when, list(keys), F.min)


def last_in_period(df: DataFrame, period: Column, when: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Rows at the latest time of each period, ties kept."""
    return _edge_per_period(df, period, when, list(keys), F.max)


def top_k(df: DataFrame, k: int, value: str = "y", out: str = "rank") -> DataFrame:
    """The k largest values with all their ties, ranked with gaps.

    Only the k largest distinct values are ever ordered in one place.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    best = counts.orderBy(F.desc_nulls_last(value)).limit(k)
    above = F.sum("_c").over(Window.partitionBy(F.lit(1)).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1))
    ranked = best.select(value, (F.coalesce(above, F.lit(0)) + 1).cast("int").alias(out)).where(F.col(out) <= k)
    return df.join(ranked, value).select(*df.columns, out)


def at_latest(panel: DataFrame, when: str = "ds") -> DataFrame:
    """Rows of the latest date."""
    return panel.where(F.col(when) == panel.agg(F.max(when)).scalar())


def market_share(panel: DataFrame, value: str = "y", when: str = "ds", digits: int = 1) -> DataFrame:
    """Share of the total at the latest date in percent."""
    latest = at_latest(panel, when)
    whole = latest.agg(F.sum(value)).scalar()
    return latest.withColumn("share", F.round(F.col(value) / whole * 100, digits))


def reorder_category(df: DataFrame, category: str, value: str, out: str = "position") -> DataFrame:
    """Sum per category and the category's position by that sum, largest first.

    The sums are sorted by range; a category's position is its place in its range plus the
    sizes of the ranges before it.
    """
    sums = df.groupBy(category).agg(F.sum(value).cast("double").alias(value))
    ranged = stage(sums.repartitionByRange(F.desc(value), F.asc(category)).withColumn("_p", F.spark_partition_id()))
    # one row per range
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(F.desc(value), category))
    return ranged.join(offsets, "_p").withColumn(out, (place + F.col("_o")).cast("int")).drop("_p", "_o")


def add_lags(panel: DataFrame, lags: Sequence[int], value: str = "y", key: str = "id", when: str = "ds") -> DataFrame:
    """Earlier values of the same series. The calendar must be padded first."""
    w = Window.partitionBy(key).orderBy(when)
    return panel.select("*", *[F.lag(value, k).over(w).alias(f"{value}_lag{k}") for k in lags])


def add_rolling(
    panel: DataFrame,
    column: str,
    periods: Sequence[int],
    align: str = "center",
    key: str = "id",
    when: str = "ds",
) -> DataFrame:
    """Sliding means with partial frames at the edges, NULLs left out."""
    w = Window.partitionBy(key).orderBy(when)

    def frame(k: int):
        back = (k - 1) // 2 if align == "center" else (k - 1 if align == "right" else 0)
        return w.rowsBetween(-back, k - 1 - back)

    return panel.select("*", *[F.avg(column).over(frame(k)).alias(f"{column}_roll{k}") for k in periods])


def lag_roll(panel: DataFrame, value: str = "y", key: str = "id", when: str = "ds") -> DataFrame:
    """Lags 3, 6 and 9 with rolling means of lag 3 over 3, 6 and 12 periods."""
    return add_rolling(add_lags(panel, (3, 6, 9), value, key, when), f"{value}_lag3", (3, 6, 12), key=key, when=when)


def rank_models(accuracy: DataFrame, metric: str = "rmse", by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Rank 1 = worst, so that ranks can serve as weights. One row per model and group."""
    groups = list(by) or [F.lit(1)]
    return accuracy.withColumn(out, F.rank().over(Window.partitionBy(*groups).orderBy(F.desc(metric))))


def sort_accuracy(accuracy: DataFrame, *metrics: str) -> DataFrame:
    """Best model first; R squared sorts downwards, errors upwards."""
    order = [F.desc_nulls_last(m) if m == "rsq" else F.asc_nulls_last(m) for m in metrics or ("rmse", "mae", "mape")]
    return accuracy.orderBy(*order)


def tail_n(panel: DataFrame, n: int, key: str = "id", when: str = "ds") -> DataFrame:
    """The last n rows of each series."""
    w = Window.partitionBy(key).orderBy(F.desc(when))
    return panel.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def pick_series(panel: DataFrame, ids: Sequence, key: str = "id") -> DataFrame:
    """A few series for a trial fit."""
    return panel.where(F.col(key).isin(list(ids)))


def interpolate(panel: DataFrame, column: str, key: str = "id", when: str = "ds") -> DataFrame:
    """Fill inner gaps linearly by row position; leading and trailing gaps stay NULL."""
    w = Window.partitionBy(key).orderBy(when)
    numbered = panel.withColumn("_r", F.row_number().over(w))
    known = F.when(F.col(column).isNotNull(), F.struct("_r", F.col(column).alias("v")))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    step = (F.col("_b.v") - F.col("_a.v")) * (F.col("_r") - F.col("_a._r")) / (F.col("_b._r") - F.col("_a._r"))
    filled = numbered.withColumn("_a", before).withColumn("_b", after)
    return filled.withColumn(column, F.coalesce(F.col(column), F.col("_a.v") + step)).select(*panel.columns)


def extend_with_anchor(
    rates: DataFrame, anchor: DataFrame, end: str | Column, column: str = "rate", key: str = "id", when: str = "ds"
) -> DataFrame:
    """Append empty months up to ``end`` (exclusive) and the anchor value at ``end``.

    ``anchor`` has one ``(id, value)`` row per series.
    """
    last = rates.groupBy(key).agg(F.max(when).alias("_last"))
    stop = F.lit(end).cast("date") if isinstance(end, str) else end
    months = F.sequence(F.add_months("_last", 1), F.add_months(stop, -1), F.expr("interval 1 month"))
    open_months = F.when(F.add_months("_last", 1) < stop, months)
    empty = last.select(key, F.explode(open_months).alias(when), F.lit(None).cast("double").alias(column))
    closing = anchor.select(key, stop.alias(when), F.col(anchor.columns[-1]).cast("double").alias(column))
    return rates.select(key, when, column).unionByName(empty).unionByName(closing)
