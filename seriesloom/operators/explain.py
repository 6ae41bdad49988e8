"""Explanations of a fitted global model."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.tuning import unit_draw
from seriesloom.session import stage


def feature_importance(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Importance of each feature in the fitted trees, with names from the feature vector."""
    vector = model.transform(rows.limit(1)).schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in vector.values() for a in kind}
    weights = model.stages[-1].featureImportances.toArray()
    table = [(names.get(i, str(i)), float(w)) for i, w in enumerate(weights)]
    return rows.sparkSession.createDataFrame(table, "feature string, importance double")


def _ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their place ``_r`` in a total order over the whole table: sorted by range, counted, and shifted by what lies before.

    The number of partitions is the only thing on the driver; ties are only between rows that are equal in ``order``.
    """
    parted = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    # ids grow within a partition, so its least one is where its rows begin
    sizes = {r["_p"]: (r["n"], r["low"]) for r in parted.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_m").alias("low")).collect()}
    before, starts = 0, []
    for p in range(max(sizes, default=-1) + 1):
        n, low = sizes.get(p, (0, 0))
        starts.append(F.lit(before - low))
        before += n
    return parted.withColumn("_r", F.col("_m") + F.element_at(F.array(*starts), F.col("_p") + 1) if starts else F.lit(0)).drop("_p", "_m")


def permutation_importance(
    model: PipelineModel, rows: DataFrame, features: Sequence[str], value: str = "y", keys: Sequence[str] = ("id", "ds"), seed: int = 0
) -> DataFrame:
    """Loss ratio when one feature's values are moved between rows.

    Each row takes the values of the next row in a hash order of the whole table, the last one those of the first: one
    permutation, whatever the layout of the table. All features are scored in one pass.
    """
    features = list(features)
    order = [F.xxhash64(*keys, F.lit(seed)), *map(F.col, keys)]
    ranked = stage(_ranked(rows, order))
    n = ranked.count()
    other = ranked.select(F.pmod(F.col("_r") - 1, F.lit(max(n, 1))).alias("_r"), F.struct(*features).alias("_o"))
    mixed = ranked.join(other, "_r")
    variants = F.array(F.lit("(baseline)"), *[F.lit(f) for f in features])
    fanned = mixed.withColumn("feature", F.explode(variants))
    swapped = fanned.withColumns({f: F.when(F.col("feature") == f, F.col(f"_o.{f}")).otherwise(F.col(f)) for f in features})
    e = F.col(value) - F.col("prediction")
    loss = model.transform(swapped).groupBy("feature").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    base = loss.where("feature = '(baseline)'").select("rmse").scalar()
    return loss.where("feature <> '(baseline)'").withColumn("ratio", F.col("rmse") / base)


def partial_dependence(model: PipelineModel, rows: DataFrame, feature: str, grid: Sequence[float]) -> DataFrame:
    """Mean prediction when the feature has each grid value in every row."""
    kind = dict(rows.dtypes)[feature]
    points = F.array(*[F.lit(v) for v in grid])
    fanned = rows.drop(feature).withColumn("_g", F.explode(points)).withColumn(feature, F.col("_g").cast(kind))
    return model.transform(fanned).groupBy(F.col("_g").cast("double").alias("at")).agg(F.avg("prediction").alias("mean_prediction"))


def local_surrogate(
    model: PipelineModel,
    observations: DataFrame,
    train: DataFrame,
    features: Sequence[str],
    k: int = 3,
    n: int = 100,
    keys: Sequence[str] = ("id", "ds"),
    seed: int = 0,
) -> DataFrame:
    """Local linear explanation per observation: the k strongest features and their effects.

    Every observation gets n Gaussian perturbations as rows, drawn from a hash so that a rerun
    of a lost task repeats them. Spark sums the weighted normal equations of each observation, and a batch of them is solved at once.
    """
    features = list(features)
    sds = train.agg(*[F.stddev_samp(f).alias(f) for f in features]).first()
    sd = {f: float(sds[f] or 0.0) for f in features}
    drawn = observations.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_i"))

    def noise(f: str) -> Column:
        u = unit_draw(*map(F.col, keys), F.col("_i"), F.lit(f), F.lit(seed))
        v = unit_draw(*map(F.col, keys), F.col("_i"), F.lit(f), F.lit(seed + 1))
        normal = F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * np.pi * v)
        return F.when(F.col("_i") == 0, F.lit(0.0)).otherwise(normal)

    kinds = dict(observations.dtypes)
    offsets = F.array(*[noise(f) for f in features])
    moved = drawn.withColumn("_z", offsets).withColumns(
        {f: (F.col(f) + F.col("_z")[i] * sd[f]).cast("double" if kinds[f] in ("int", "bigint") else kinds[f]) for i, f in enumerate(features)}
    )
    scored = model.transform(moved).select(*keys, F.concat(F.array(F.lit(1.0)), "_z").alias("_x"), "prediction")
    width = 0.75 * np.sqrt(len(features))
    squares = F.aggregate("_x", F.lit(-1.0), lambda s, x: s + x * x)
    scored = scored.withColumn("_w", F.exp(-squares / (2 * width**2)))
    # the weighted normal equations of each observation, summed in the map stage
    p = len(features) + 1
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.sum(F.col("_w") * F.col("_x")[i] * F.col("_x")[j]) for i, j in cells] + [F.sum(F.col("_w") * F.col("_x")[i] * F.col("prediction")) for i in range(p)]
    equations = scored.groupBy(*keys).agg(F.array(*sums).alias("_e"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            e = np.vstack(batch["_e"].to_numpy()).astype(float)
            left = np.zeros((len(e), p, p))
            for c, (i, j) in enumerate(cells):
                left[:, i, j] = left[:, j, i] = e[:, c]
            beta = np.einsum("nij,nj->ni", np.linalg.pinv(left, hermitian=True), e[:, len(cells) :])
            top = np.argsort(-np.abs(beta[:, 1:]), axis=1, kind="stable")[:, :k]
            head = batch[list(keys)].loc[np.repeat(batch.index.to_numpy(), top.shape[1])].reset_index(drop=True)
            yield head.assign(feature=[features[t] for t in top.ravel()], effect=np.take_along_axis(beta[:, 1:], top, axis=1).ravel(), intercept=np.repeat(beta[:, 0], top.shape[1]))

    key_types = ", ".join(f"{c} {kinds[c]}" for c in keys)
    return equations.mapInPandas(solve, f"{key_types}, feature string, effect double, intercept double")
