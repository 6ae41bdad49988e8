"""Exact quantiles of groups that may hold a large share of all rows.

Spark's exact ``percentile`` keeps every distinct value of a group in one task. Here equal values meet in the map stage, and
their counts are written once. Groups of few distinct values are ordered as they are. In the others, values get a whole
number that keeps their order (exponent and leading bits of the double); its leading bits form cells, the cells are counted
with map-side combining, and the cells that hold a wanted rank are divided by the next bits until they have few distinct
values. Only those are ordered. Every row counts; nothing is sampled, and far outliers do not make a cell large.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.session import stage

#: distinct values that one task may order
SMALL = 200_000
#: bits below a cell, after each division
SHIFTS = (46, 34, 22, 10, 0)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], small: int = SMALL) -> DataFrame:
    """One row per group with ``n`` and one interpolated quantile column per entry of ``probs``.

    Interpolation between neighbours is linear, as in SQL's PERCENTILE_CONT. NULLs are left out, NaN is the largest value.
    """
    by = list(by)
    if not by:
        return exact_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, probs, small).drop("_all")
    return quantiles_of_counts(value_counts(df, by, value), by, probs, small)


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Number ``_c`` of each distinct value ``_v`` of each group, NULL among them, written once."""
    return stage(df.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))


def quantiles_of_counts(counts: DataFrame, by: Sequence[str], probs: dict[str, float], small: int = SMALL) -> DataFrame:
    by = list(by)
    # one spelling of the group's columns, so that NULL keys meet as well
    counts = counts.where(F.col("_v").isNotNull()).withColumn("_g", F.struct(*by))
    sizes = counts.groupBy("_g").agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("_d"))
    if not (sizes.agg(F.max("_d")).first()[0] or 0) > small:
        whole = counts.withColumn("n", F.sum("_c").over(Window.partitionBy(*by)))
        return _read(_hits(whole.select(*by, "n", "_v", "_c", F.lit(0).alias("_start")), by, probs), by, probs)
    open_cells = stage(sizes.select("_g", "n", F.lit(0).cast("long").alias("_start"), "_d", F.lit(None).cast("long").alias("_cell")))
    keyed = _with_key(counts)
    done = [(None, open_cells.where(F.col("_d") <= small))]
    open_cells, above = open_cells.where(F.col("_d") > small), None
    for shift in SHIFTS:
        inside = _rows_of(keyed, open_cells, above)
        cells = inside.groupBy("_g", "n", "_start", F.shiftright("_key", shift).alias("_cell")).agg(F.sum("_c").alias("_cc"), F.count(F.lit(1)).alias("_d"))
        running = Window.partitionBy("_g", "_start").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("_start", F.col("_start") + F.coalesce(F.sum("_cc").over(running), F.lit(0)))
        cells = stage(cells.where(_has_rank(probs, "_start", "_cc")).select("_g", "n", "_start", "_d", "_cell"))
        last = shift == SHIFTS[-1]
        done.append((shift, cells if last else cells.where(F.col("_d") <= small)))
        open_cells, above = cells.where(F.col("_d") > small), shift
        if last or open_cells.isEmpty():
            break
    rows = None
    for shift, cells in done:
        part = _rows_of(keyed, cells, shift).select(*by, "n", "_v", "_c", "_start")
        rows = part if rows is None else rows.unionByName(part)
    return _read(_hits(rows, [*by, "_start"], probs), by, probs)


def _rows_of(keyed: DataFrame, cells: DataFrame, shift: int | None) -> DataFrame:
    """The values inside the cells, with the number of rows before the cell."""
    cells = cells.select("_g", "n", "_start", F.col("_cell").alias("_in"))
    if shift is None:
        return keyed.join(cells.drop("_in"), "_g")
    return keyed.withColumn("_in", F.shiftright("_key", shift)).join(cells, ["_g", "_in"]).drop("_in")


def _ranks(probs: dict[str, float]) -> list[Column]:
    """The ranks on both sides of each wanted place, from 0."""
    return [r for p in probs.values() for r in (F.floor((F.col("n") - 1) * F.lit(p)), F.ceil((F.col("n") - 1) * F.lit(p)))]


def _has_rank(probs: dict[str, float], start: str, count: str) -> Column:
    inside = [(r >= F.col(start)) & (r < F.col(start) + F.col(count)) for r in _ranks(probs)]
    return reduce(lambda a, b: a | b, inside)


def _hits(rows: DataFrame, cell: list[str], probs: dict[str, float]) -> DataFrame:
    """The values at the wanted ranks of each cell."""
    order = Window.partitionBy(*cell).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_at", F.col("_start") + F.coalesce(F.sum("_c").over(order), F.lit(0)))
    inside = F.filter(F.array_distinct(F.array(*_ranks(probs))), lambda r: (r >= F.col("_at")) & (r < F.col("_at") + F.col("_c")))
    return placed.where(_has_rank(probs, "_at", "_c")).withColumn("_hit", F.explode(inside))


def _read(hits: DataFrame, by: list[str], probs: dict[str, float]) -> DataFrame:
    found = hits.groupBy(*by).agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_hit", "_v"))).alias("_at"))
    return found.select(*by, "n", *[_interpolate(p).alias(name) for name, p in probs.items()])


def _with_key(counts: DataFrame) -> DataFrame:
    """A long that keeps the order of doubles: the exponent above 51 bits of the fraction.

    Two neighbouring doubles may share a key, so the last cells have two values at most.
    """
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    size = F.col("_size")
    finite = (size > 0) & (size < F.lit(float("inf")))
    sized = counts.withColumn("_size", F.abs("_v"))
    # the logarithm may be off by one beside a power of two
    sized = sized.withColumn("_e", F.when(finite, F.floor(F.log2("_size"))).otherwise(F.lit(0)).cast("long"))
    sized = sized.withColumn("_e", F.col("_e") - (power(F.col("_e")) > size).cast("long"))
    sized = sized.withColumn("_e", F.col("_e") + (power(F.col("_e") + 1) <= size).cast("long"))
    unit = 1 << 51
    step = (F.col("_e") + 1074) * F.lit(unit) + F.floor((size / power(F.col("_e")) - 1) * F.lit(float(unit))) + 1
    key = F.when(F.isnan("_v"), F.lit(2100 * unit)).when(size == 0, F.lit(0)).when(finite, step).otherwise(F.lit(2099 * unit))
    return sized.withColumn("_key", F.when(F.col("_v") < 0, -key).otherwise(key)).drop("_size", "_e")


def _interpolate(p: float) -> Column:
    pos = (F.col("n") - 1) * F.lit(p)
    low = F.element_at("_at", F.floor(pos))
    high = F.element_at("_at", F.ceil(pos))
    return low + (high - low) * (pos - F.floor(pos))


def array_quantile(values: Column, p: float) -> Column:
    """The interpolated quantile of an array of bounded length; NULLs are left out, an empty array gives NULL."""
    kept = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    pos = (F.size(kept) - 1) * F.lit(p)
    at = lambda place: F.get(kept, place.cast("int"))
    return at(F.floor(pos)) + (at(F.ceil(pos)) - at(F.floor(pos))) * (pos - F.floor(pos))
