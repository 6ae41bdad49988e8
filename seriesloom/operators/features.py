"""Calendar, Fourier and scaling features, and the preprocessing pipeline of the global models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import FeatureHasher, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.columns import fourier_pair, month_index
from seriesloom.operators.cleaning import numeric_columns


def add_calendar(panel: DataFrame, when: str = "ds", key: str = "id") -> DataFrame:
    """Calendar signature of each date; ``diff`` is the days since the series' previous row."""
    d = F.col(when)
    prev = F.lag(when).over(Window.partitionBy(key).orderBy(when))
    iso_year = F.expr(f"extract(yearofweek from {when})")
    return panel.select(
        "*",
        F.unix_date(d).cast("bigint").alias("index_num"),
        F.datediff(d, prev).alias("diff"),
        F.year(d).alias("year"),
        iso_year.cast("int").alias("year_iso"),
        F.when(F.month(d) <= 6, 1).otherwise(2).alias("half"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_lbl"),
        F.dayofmonth(d).alias("day"),
        F.dayofweek(d).alias("wday"),
        F.date_format(d, "EEEE").alias("wday_lbl"),
        F.dayofmonth(d).alias("mday"),
        (F.datediff(d, F.trunc(d, "quarter")) + 1).alias("qday"),
        F.dayofyear(d).alias("yday"),
        F.floor((F.dayofyear(d) - 1) / 7 + 1).cast("int").alias("week"),
        F.weekofyear(d).alias("week_iso"),
        F.floor((F.dayofmonth(d) - 1) / 7 + 1).cast("int").alias("mweek"),
    )


def add_fourier(panel: DataFrame, periods: Sequence[float] = (12,), K: int = 1, when: str = "ds") -> DataFrame:
    """Sine and cosine of the month index per period and order."""
    t = month_index(when)
    pairs = []
    for p in periods:
        for k in range(1, K + 1):
            sin, cos = fourier_pair(t, p, k)
            pairs += [sin.alias(f"sin{p}_k{k}"), cos.alias(f"cos{p}_k{k}")]
    return panel.select("*", *pairs)


FORWARD = {"log1p": F.log1p, "log": F.ln, "log_offset": lambda c: F.ln(F.col(c) + 1)}
BACKWARD = {"log1p": F.expm1, "log": F.exp, "log_offset": lambda c: F.exp(c) - 1}


def transform(df: DataFrame, how: str, column: str = "y") -> DataFrame:
    """Apply a log transform; values outside its domain become NULL."""
    return df.withColumn(column, FORWARD[how](column))


def inverse_transform(df: DataFrame, how: str, column: str = "y") -> DataFrame:
    return df.withColumn(column, BACKWARD[how](column))


def moments_by(panel: DataFrame, key: str = "id", value: str = "y") -> DataFrame:
    return panel.groupBy(key).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))


def standardize(panel: DataFrame, params: DataFrame | None = None, value: str = "y", key: str = "id", out: str = "z") -> DataFrame:
    """z-score per series; NULL where the series does not vary. ``params`` are fitted elsewhere if given."""
    params = params if params is not None else moments_by(panel, key, value)
    z = F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mean")) / F.col("_sd"))
    return panel.join(params, key).withColumn(out, z).drop("_mean", "_sd")


def unstandardize(df: DataFrame, params: DataFrame, value: str = "z", key: str = "id", out: str = "y") -> DataFrame:
    return df.join(params, key).withColumn(out, F.col(value) * F.col("_sd") + F.col("_mean")).drop("_mean", "_sd")


def fit_range(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Limits of each column on the training rows (one small row)."""
    row = train.agg(*[f(c).cast("double").alias(f"{n}{c}") for c in columns for n, f in (("<", F.min), (">", F.max))]).first()
    return {c: (row[f"<{c}"], row[f">{c}"]) for c in columns}


def range_scale(df: DataFrame, limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Scale columns to [0, 1] by limits from training; a constant column becomes 0.5."""
    scaled = {
        c: (F.col(c) - lo) / (hi - lo) if hi > lo else F.when(F.col(c).isNotNull(), F.lit(0.5))
        for c, (lo, hi) in limits.items()
    }
    return df.withColumns(scaled)


def scale_sd(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Divide by the training deviation, without centring."""
    sds = train.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    return df.withColumns({c: F.col(c) / F.lit(sds[c]) for c in columns if sds[c]})


def categories(df: DataFrame, column: str, limit: int = 1000) -> list:
    """Sorted distinct values of a column that is meant to be nominal; refuses a long list."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} values; it is not nominal")
    return sorted(found)


def one_hot(df: DataFrame, columns: Sequence[str], drop_first: bool = True, levels: Mapping[str, list] | None = None) -> DataFrame:
    """0/1 columns per level, with levels from training if given."""
    levels = levels or {c: categories(df, c) for c in columns}
    dummies = [
        F.when(F.col(c) == F.lit(v), 1).otherwise(0).alias(f"{c}_{v}")
        for c in columns
        for v in levels[c][1 if drop_first else 0 :]
    ]
    return df.select(*[c for c in df.columns if c not in columns], *dummies)


def zero_variance(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Columns that hold one value or none, found in one pass."""
    columns = list(columns or df.columns)
    row = df.agg(*[F.min(c).eqNullSafe(F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def drop_zero_variance(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.drop(*zero_variance(df, columns))


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, str, float]]:
    """Pearson correlation of every pair of feature columns, from one pass over the rows."""
    known = df.select(*columns).dropna()  # a correlation is of rows that have all the columns
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="error").transform(known).select("_x")
    m = Correlation.corr(vectors, "_x").first()[0].toArray()
    return [(a, b, float(m[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]


def correlated_columns(pairs: Sequence[tuple[str, str, float]], threshold: float = 0.9) -> list[str]:
    """Which features to drop: from the strongest pair down, the one with the larger mean correlation."""
    strength: dict[str, list[float]] = {}
    for a, b, r in pairs:
        if r == r:
            strength.setdefault(a, []).append(abs(r))
            strength.setdefault(b, []).append(abs(r))
    mean = {c: sum(v) / len(v) for c, v in strength.items()}
    gone: list[str] = []
    for a, b, r in sorted(pairs, key=lambda p: -abs(p[2]) if p[2] == p[2] else 0.0):
        if r == r and abs(r) > threshold and a not in gone and b not in gone:
            gone.append(a if mean[a] >= mean[b] else b)
    return gone


def drop_correlated(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.9) -> DataFrame:
    columns = list(columns or numeric_columns(df))
    return df.drop(*correlated_columns(correlation_pairs(df, columns), threshold))


class FeaturePipeline:
    """Preprocessing fitted on training rows and applied to any split.

    Roles: ``predictors`` (numeric), ``nominal``, ``outcome`` and ``indicator`` columns, which pass through untouched. A nominal
    column is hashed into ``width`` places, so the vector does not grow with the number of series, no list of levels is
    kept, and a level that training has not seen is encoded like any other.
    """

    def __init__(self, predictors: Sequence[str], nominal: Sequence[str] = (), outcome: str = "y", indicator: Sequence[str] = (), width: int = 64):
        self.predictors, self.nominal, self.width = list(predictors), list(nominal), width
        self.outcome, self.indicator = outcome, list(indicator)

    def stages(self) -> list:
        stages: list = []
        if self.nominal:
            # numeric ids need a text form before they can be indexed
            texts = ", ".join(f"CAST({c} AS STRING) AS {c}__s" for c in self.nominal)
            stages.append(SQLTransformer(statement=f"SELECT *, {texts} FROM __THIS__"))
            for c in self.nominal:
                stages.append(FeatureHasher(inputCols=[f"{c}__s"], outputCol=f"{c}__v", numFeatures=self.width))
        stages.append(
            VectorAssembler(
                inputCols=[*self.predictors, *[f"{c}__v" for c in self.nominal]], outputCol="features", handleInvalid="error"
            )
        )
        return stages

    def fit(self, train: DataFrame) -> PipelineModel:
        return Pipeline(stages=self.stages()).fit(train)

    def roles(self, train: DataFrame) -> DataFrame:
        """Which column has which role and type."""
        kinds = dict(train.dtypes)
        rows = [
            (c, kinds.get(c), role)
            for role, names in (
                ("predictor", [*self.predictors, *self.nominal]),
                ("outcome", [self.outcome]),
                ("indicator", self.indicator),
            )
            for c in names
        ]
        return train.sparkSession.createDataFrame(rows, "variable string, type string, role string")


def as_array(df: DataFrame, vector: str = "features", out: str = "x") -> DataFrame:
    return df.withColumn(out, vector_to_array(vector))
