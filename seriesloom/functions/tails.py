"""Upper tail of the chi-square distribution as a column."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    """Complementary error function, which Spark SQL lacks."""
    return x.map(math.erfc, na_action="ignore")


def chi2_tail(stat: Column, df: int) -> Column:
    """P(X > stat) for ``df`` degrees of freedom.

    A finite sum in plain SQL; only an odd ``df`` needs the error function.
    """
    half = stat / 2
    if df % 2 == 0:
        powers, start = range(df // 2), F.lit(0.0)
    else:
        powers, start = [i + 0.5 for i in range(df // 2)], erfc(F.sqrt(half))
    terms = [F.exp(-half) * F.pow(half, F.lit(float(p))) / math.gamma(p + 1) for p in powers]
    return sum(terms, start)
