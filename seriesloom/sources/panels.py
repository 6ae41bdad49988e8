"""Reading and writing panels, forecast tables and fitted models."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY = T.StructType(
    [
        T.StructField("model_id", T.IntegerType()),
        T.StructField("model_desc", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    ]
)


def write_panel(df: DataFrame, path: str, when: str = "ds", mode: str = "errorifexists") -> None:
    """Write a panel by year, so that date filters skip whole folders on reading."""
    df.withColumn("ds_year", F.year(when)).write.mode(mode).partitionBy("ds_year").parquet(path)


def read_panel(spark: SparkSession, path: str, since: str | None = None, when: str = "ds") -> DataFrame:
    df = spark.read.parquet(path)
    if since is not None:
        df = df.where((F.col("ds_year") >= F.year(F.lit(since).cast("date"))) & (F.col(when) >= F.lit(since).cast("date")))
    return df.drop("ds_year")


def write_forecast(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_models(
    spark: SparkSession,
    path: str,
    models: Mapping[str, PipelineModel],
    params: Mapping[str, Mapping[str, str]] | None = None,
) -> DataFrame:
    """Save fitted pipelines and the table that describes them; returns that table."""
    params = params or {}
    rows = []
    for number, (desc, model) in enumerate(models.items(), start=1):
        target = f"{path}/model-{number}"
        model.write().overwrite().save(target)
        rows.append((number, desc, target, {k: str(v) for k, v in params.get(desc, {}).items()}))
    registry = spark.createDataFrame(rows, REGISTRY)
    registry.coalesce(1).write.mode("overwrite").parquet(f"{path}/registry")
    return spark.read.schema(REGISTRY).parquet(f"{path}/registry")


def load_models(spark: SparkSession, path: str) -> dict[str, PipelineModel]:
    """Load every pipeline named in a saved registry (a handful of rows)."""
    registry = spark.read.schema(REGISTRY).parquet(f"{path}/registry")
    return {r["model_desc"]: PipelineModel.load(r["path"]) for r in registry.orderBy("model_id").collect()}
