"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_of(when: str | Column) -> Column:
    """First day of the month as a date."""
    return F.trunc(F.col(when) if isinstance(when, str) else when, "month")


def month_index(when: str | Column) -> Column:
    """Months since year 0, so that consecutive months differ by one."""
    col = F.col(when) if isinstance(when, str) else when
    return F.year(col) * 12 + F.month(col) - 1


def money(df: DataFrame, *columns: str) -> DataFrame:
    """Columns as decimals of two places, so that their sums do not depend on the order of the rows."""
    return df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in columns})


def add_months(when: str | Column, months: int | Column) -> Column:
    return F.add_months(when, months)


def fourier_pair(index: Column, period: float, order: int) -> tuple[Column, Column]:
    angle = index * F.lit(2.0 * math.pi * order / period)
    return F.sin(angle), F.cos(angle)
