"""Padding, future frames, splits and resampling plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pad_calendar(
    panel: DataFrame,
    values: Sequence[str] = ("y",),
    bounds: tuple[Column, Column] | None = None,
    fill: float | None = 0.0,
    key: str = "id",
    when: str = "ds",
) -> DataFrame:
    """Give every series one row per month between common bounds.

    One shuffle by series: each row unfolds into itself and the empty months up to the next
    row, the first row also into those before it. The result stays partitioned by series, so
    later windows over it need no further shuffle. Months outside the bounds are dropped.
    """
    low, high = bounds or (panel.agg(F.min(when)).scalar(), panel.agg(F.max(when)).scalar())
    w = Window.partitionBy(key).orderBy(when)
    inside = panel.where((F.col(when) >= low) & (F.col(when) <= high))
    spans = inside.select(
        key,
        F.col(when).alias("_at"),
        *values,
        F.when(F.lag(when).over(w).isNull(), low).otherwise(F.col(when)).alias("_from"),
        F.coalesce(F.add_months(F.lead(when).over(w), -1), high).alias("_to"),
    )
    laid = spans.withColumn(when, F.explode(F.sequence("_from", "_to", F.expr("interval 1 month"))))
    cell = lambda v: F.when(F.col(when) == F.col("_at"), F.col(v)).otherwise(F.lit(fill).cast("double")).alias(v)
    return laid.select(key, when, *[cell(v) for v in values])


def future_frame(panel: DataFrame, h: int, bind: bool = True, key: str = "id", when: str = "ds") -> DataFrame:
    """Append h empty months after each series' last one; other columns are NULL there."""
    last = panel.groupBy(key).agg(F.max(when).alias("_last"))
    steps = F.sequence(F.add_months("_last", 1), F.add_months("_last", h), F.expr("interval 1 month"))
    ahead = last.select(key, F.explode(steps).alias(when))
    return panel.unionByName(ahead, allowMissingColumns=True) if bind else ahead


def mark_future(panel: DataFrame, h: int, key: str = "id", when: str = "ds") -> DataFrame:
    """Extend each series and say which rows are actual and which are future."""
    return future_frame(panel.withColumn("split", F.lit("actual")), h, key=key, when=when).fillna("future", ["split"])


def split_last_n(panel: DataFrame, n: int, key: str = "id", when: str = "ds") -> DataFrame:
    """Hold out the last n rows of each series."""
    w = Window.partitionBy(key).orderBy(F.desc(when))
    return panel.withColumn("split", F.when(F.row_number().over(w) <= n, "test").otherwise("train"))


def split_last_period(panel: DataFrame, months: int, when: str = "ds") -> DataFrame:
    """Hold out the last months of the whole panel; training data grows from the start."""
    last = panel.agg(F.max(when)).scalar()
    return panel.withColumn("split", F.when(F.col(when) > F.add_months(last, -months), "test").otherwise("train"))


def cv_plan(panel: DataFrame, holdouts: Sequence[int], when: str = "ds", rolling: int = 0) -> DataFrame:
    """Unroll time-based splits to rows: one copy of the panel per split, with a split name and key.

    ``holdouts`` are hold-out lengths in months; with ``rolling`` each further slice ends that
    many months earlier. Rows later than a slice's end are left out of that slice.
    """
    last = panel.agg(F.max(when)).scalar()
    plans = F.array(
        *[
            F.struct(F.lit(f"Slice{i + 1}").alias("split_id"), F.lit(m).alias("_m"), F.lit(i * rolling).alias("_back"))
            for i, m in enumerate(holdouts)
        ]
    )
    fanned = panel.select("*", F.inline(plans))
    end = F.add_months(last, -F.col("_back"))
    key = F.when(F.col(when) > F.add_months(end, -F.col("_m")), "testing").otherwise("training")
    return fanned.where(F.col(when) <= end).withColumn("key", key).drop("_m", "_back")


def kfold(panel: DataFrame, v: int, seed: int = 0, key: str = "id", when: str = "ds", out: str = "fold") -> DataFrame:
    """Random folds that depend only on the row's key and the seed, so reruns agree."""
    return panel.withColumn(out, F.pmod(F.xxhash64(F.col(key), F.col(when), F.lit(seed)), F.lit(v)).cast("int"))


def time_folds(panel: DataFrame, v: int, when: str = "ds", out: str = "fold") -> DataFrame:
    """Folds that are blocks of consecutive months."""
    first, last = panel.agg(F.min(when)).scalar(), panel.agg(F.max(when)).scalar()
    at = lambda d: F.year(d) * 12 + F.month(d)
    share = (at(F.col(when)) - at(first)) / (at(last) - at(first) + 1)
    return panel.withColumn(out, F.least(F.floor(share * v), F.lit(v - 1)).cast("int"))
