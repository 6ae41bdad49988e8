"""Parameter designs and their evaluation on folds."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.operators.features import FeaturePipeline
from seriesloom.operators.global_models import estimator, held_back
from seriesloom.session import stage, unstage

# Parameters that are drawn on a log10 scale
LOG_SCALE = {"stepSize", "minInfoGain"}
# Parameters that are whole numbers
WHOLE = {"numTrees", "maxIter", "maxDepth", "minInstancesPerNode", "maxBins", "mtry"}


def unit_draw(*parts: Column) -> Column:
    """A number in [0, 1) that depends only on its arguments."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / F.lit(float(1 << 30))


def latin_hypercube(spark: SparkSession, ranges: Mapping[str, tuple[float, float]], n: int, seed: int = 0) -> DataFrame:
    """n parameter rows with one point in each of n strata of every parameter.

    Strata are permuted by a seeded hash. Reversed bounds are put in order.
    """
    table = F.array(*[F.struct(F.lit(p).alias("param"), F.lit(float(min(r))).alias("lo"), F.lit(float(max(r))).alias("hi")) for p, r in ranges.items()])
    cells = spark.range(n).select(F.col("id").cast("int").alias("i"), F.inline(table))
    order = Window.partitionBy("param").orderBy(F.xxhash64("param", "i", F.lit(seed)), "i")
    stratum = (F.row_number().over(order) - 1).cast("double")
    u = unit_draw(F.col("param"), F.col("i"), F.lit(seed + 1))
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * (stratum + u) / n
    value = F.when(F.col("param").isin(*LOG_SCALE), F.pow(F.lit(10.0), at)).when(F.col("param").isin(*WHOLE), F.round(at)).otherwise(at)
    wide = cells.withColumn("value", value).groupBy("i").pivot("param", list(ranges)).agg(F.first("value"))
    return wide.withColumnRenamed("i", "config_id")


def mllib_params(row: Mapping[str, float], n_features: int) -> dict:
    """Parameter values in the types and names MLlib takes; mtry is a number of places of the feature vector."""
    out: dict = {}
    for name, v in row.items():
        if name == "mtry":
            out["featureSubsetStrategy"] = str(max(1, min(int(v), n_features)))
        else:
            out[name] = int(v) if name in WHOLE else float(v)
    return out


def vector_width(prepared: DataFrame) -> int:
    """Places of the assembled feature vector, hashed ones included."""
    return int(prepared.schema["features"].metadata["ml_attr"]["num_attrs"])


SCORES = "model string, round int, config_id int, fold int, rmse double, rsq double"


def known_scores(spark: SparkSession, log: str | None, name: str, number: int) -> dict[tuple[int, int], tuple[float, float]]:
    """Scores of a model's round that an earlier run has written to ``log``, by configuration and fold."""
    if log is None:
        return {}
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return {}
    # configurations times folds, at most
    rows = spark.read.schema(SCORES).parquet(f"{log}/*").where((F.col("model") == name) & (F.col("round") == number)).collect()
    return {(r["config_id"], r["fold"]): (r["rmse"], r["rsq"]) for r in rows}


def tune(
    rows: DataFrame,
    kind: str,
    grid: DataFrame,
    predictors: Sequence[str],
    nominal: Sequence[str] = (),
    value: str = "y",
    fold: str = "fold",
    parallelism: int = 4,
    fixed: Mapping[str, object] | None = None,
    log: str | None = None,
    name: str | None = None,
    number: int = 1,
    stop: float | None = None,
) -> DataFrame:
    """Fit every configuration on every fold's complement and score it on the fold.

    The design is a handful of rows; each fit is a Spark job, and ``parallelism`` of them run
    side by side. Preprocessing is fitted per fold, on training rows only; folds are done one after the other, so one
    training table is held at a time. Returns the mean rmse and rsq with their standard errors per configuration.

    With ``log``, a folder in shared storage, each score is written there as soon as it is known, under the model's ``name``
    and the round's ``number``; a driver that starts again goes on where the former one ended. ``stop`` ends boosting early.
    """
    spark = rows.sparkSession
    folds = [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]
    configs = [r.asDict() for r in grid.orderBy("config_id").collect()]
    name = name or kind
    known = known_scores(spark, log, name, number)
    scores = [(c, k, *s) for (c, k), s in known.items()]
    for k in folds:
        todo = [c for c in configs if (c["config_id"], k) not in known]
        if not todo:
            continue
        train, held = rows.where(F.col(fold) != k), rows.where(F.col(fold) == k)
        pipe = FeaturePipeline(predictors, nominal, value).fit(train)
        ready = stage(_stopping(pipe.transform(train), train.columns, kind, stop))
        width = vector_width(pipe.transform(train))
        early = {"validationIndicatorCol": "_held", "validationTol": stop} if "_held" in ready.columns else {}

        def one(config: dict) -> tuple:
            params = mllib_params({p: v for p, v in config.items() if p != "config_id"}, width)  # noqa: B023
            model = estimator(kind, value, **{**(fixed or {}), **params, **early}).fit(ready)  # noqa: B023
            score = score_row(model.transform(pipe.transform(held)), value)  # noqa: B023
            row = (config["config_id"], int(k), score["rmse"], score["rsq"])  # noqa: B023
            if log is not None:
                # a folder for each score, since writers of one folder would clear each other's files
                done = spark.createDataFrame([(name, number, *row)], SCORES).coalesce(1)
                done.write.mode("overwrite").parquet(f"{log}/{name}-{number}-{row[0]}-{row[1]}")
            return row

        pool = ThreadPool(parallelism)
        try:
            scores += pool.map(inheritable_thread_target(spark)(one), todo)
        finally:
            pool.close()
        unstage(ready)
    table = spark.createDataFrame(scores, "config_id int, fold int, rmse double, rsq double")
    mean = table.groupBy("config_id").agg(
        F.avg("rmse").alias("rmse"),
        (F.stddev_samp("rmse") / F.sqrt(F.count(F.lit(1)))).alias("rmse_se"),
        F.avg("rsq").alias("rsq"),
        F.count(F.lit(1)).alias("n"),
    )
    return grid.join(mean, "config_id")


def _stopping(rows: DataFrame, columns: Sequence[str], kind: str, stop: float | None) -> DataFrame:
    return rows.withColumn("_held", held_back(columns)) if stop is not None and kind == "gbt" else rows


def tune_rounds(
    rows: DataFrame,
    kind: str,
    ranges: Mapping[str, tuple[float, float]],
    predictors: Sequence[str],
    nominal: Sequence[str] = (),
    points: Sequence[int] = (20, 20, 10),
    top: int = 5,
    metric: str = "rsq",
    seed: int = 320,
    **options,
) -> DataFrame:
    """Rounds of tuning, each within the ranges that the best configurations of the one before span.

    Gives all configurations of all rounds with their scores and the number of the round.
    """
    found = None
    for number, n in enumerate(points, 1):
        grid = stage(latin_hypercube(rows.sparkSession, ranges, n, seed + number))
        out = stage(tune(rows, kind, grid, predictors, nominal, number=number, **options).withColumn("round", F.lit(number)))
        found = out if found is None else found.unionByName(out)
        ranges = narrow(out, list(ranges), metric, top)
    return found


def score_row(held: DataFrame, value: str):
    y, f = F.col(value), F.col("prediction")
    spread = F.nullif(F.var_pop(y) * F.var_pop(f), F.lit(0.0))
    return held.agg(F.sqrt(F.avg((y - f) * (y - f))).alias("rmse"), (F.pow(F.covar_pop(y, f), F.lit(2.0)) / spread).alias("rsq")).first()


def narrow(results: DataFrame, params: Sequence[str], metric: str = "rmse", top: int = 5) -> dict[str, tuple[float, float]]:
    """Ranges spanned by the best configurations, for the next round."""
    order = F.desc(metric) if metric == "rsq" else F.asc(metric)
    best = results.orderBy(order, "config_id").limit(top)
    row = best.agg(*[f(p).alias(f"{n}{p}") for p in params for n, f in (("<", F.min), (">", F.max))]).first()
    ranges = {p: (row[f"<{p}"], row[f">{p}"]) for p in params}
    log = lambda p, v: math.log10(v) if p in LOG_SCALE else v
    return {p: (log(p, lo), log(p, hi)) for p, (lo, hi) in ranges.items()}


def finalize(
    rows: DataFrame,
    kind: str,
    results: DataFrame,
    predictors: Sequence[str],
    nominal: Sequence[str] = (),
    value: str = "y",
    metric: str = "rmse",
    fixed: Mapping[str, object] | None = None,
) -> PipelineModel:
    """Take the best configuration and fit it on all training rows."""
    order = F.desc(metric) if metric == "rsq" else F.asc(metric)
    best = results.orderBy(order, "config_id").first().asDict()
    params = {p: v for p, v in best.items() if p not in ("config_id", "rmse", "rmse_se", "rsq", "n", "round")}
    pipe = FeaturePipeline(predictors, nominal, value).fit(rows)
    ready = pipe.transform(rows)
    model = estimator(kind, value, **{**(fixed or {}), **mllib_params(params, vector_width(ready))}).fit(ready)
    return PipelineModel(stages=[*pipe.stages, model])
