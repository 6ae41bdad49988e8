import numpy as np
import pytest
from conftest import panel
from pyspark.sql import functions as F

from seriesloom.operators import calendar, explain, features, global_models as gm, ordered, tuning


@pytest.fixture(scope="module")
def rows(spark):
    t = np.arange(72)
    p = panel(spark, {i: 10 * i + 3 * np.sin(2 * np.pi * t / 12) for i in range(1, 5)})
    f = ordered.add_lags(features.add_fourier(features.add_calendar(p)), range(1, 7))
    return calendar.split_last_n(f.dropna(subset=["y_lag6"]), 12).cache()


PREDICTORS = [*gm.CALENDAR, *[f"y_lag{k}" for k in range(1, 7)]]


@pytest.fixture(scope="module")
def model(rows):
    return gm.fit_global(rows.where("split = 'train'"), "gbt", PREDICTORS, ["id"], maxIter=10, maxDepth=4)


def test_global_model_beats_the_mean(rows, model):
    held = model.transform(rows.where("split = 'test'"))
    assert tuning.score_row(held, "y")["rsq"] > 0.9


def test_recursion_equals_one_step_prediction_at_first(rows, model):
    train = rows.where("split = 'train'")
    ahead = gm.recursive_forecast(model, train.select("id", "ds", "y"), 12)
    assert ahead.count() == 48
    first = ahead.groupBy("id").agg(F.min_by("value", "ds").alias("v"), F.min("ds").alias("ds"))
    direct = model.transform(rows.where("split = 'test'")).select("id", "ds", "prediction")
    for r in first.join(direct, ["id", "ds"]).collect():
        assert r["v"] == pytest.approx(r["prediction"])


def test_latin_hypercube_fills_every_stratum(spark):
    grid = tuning.latin_hypercube(spark, {"x": (5, 1), "minInfoGain": (-3, -1)}, 10, seed=4).toPandas()
    strata = np.floor((grid["x"] - 1) / 4 * 10).astype(int)
    assert sorted(strata) == list(range(10))
    logs = np.floor((np.log10(grid["minInfoGain"]) + 3) / 2 * 10).astype(int)
    assert sorted(logs) == list(range(10))


def test_tuning_scores_every_configuration(spark, rows):
    folds = calendar.time_folds(rows.where("split = 'train'"), 2)
    grid = tuning.latin_hypercube(spark, {"minInstancesPerNode": (1, 30)}, 2, seed=1)
    out = tuning.tune(folds, "rf", grid, PREDICTORS, ["id"], fixed={"numTrees": 5})
    assert [r["n"] for r in out.collect()] == [2, 2]
    final = tuning.finalize(rows, "rf", out, PREDICTORS, ["id"], fixed={"numTrees": 5})
    assert final.transform(rows).count() == rows.count()


def test_explanations(rows, model):
    test = rows.where("split = 'test'")
    weights = {r["feature"]: r["importance"] for r in explain.feature_importance(model, rows).collect()}
    assert sum(weights.values()) == pytest.approx(1.0)
    lags = [f for f in PREDICTORS if f.startswith("y_lag")]
    moved = {r["feature"]: r["ratio"] for r in explain.permutation_importance(model, test, [*lags, "half"]).collect()}
    assert set(moved) == {*lags, "half"}
    unused = [f for f in moved if weights.get(f, 0.0) == 0.0]
    assert all(moved[f] == pytest.approx(1.0) for f in unused)
    assert max(moved.values()) > 1.1
    strongest = max((f for f in weights if f.startswith("y_lag")), key=weights.get)
    pdp = explain.partial_dependence(model, rows, strongest, [10.0, 40.0]).orderBy("at").collect()
    assert pdp[0]["mean_prediction"] < pdp[1]["mean_prediction"]
    local = explain.local_surrogate(model, test, rows, ["y_lag1", "y_lag2", "sin12_k1"], k=2, n=50).groupBy("id", "ds").count()
    assert {r["count"] for r in local.collect()} == {2}


def test_encoding_is_fitted_on_training_rows(rows):
    pipe = features.FeaturePipeline(["y_lag1"], ["id"]).fit(rows.where("split = 'train' AND id < 4"))
    # an id that training did not see gets its own level and does not fail
    assert pipe.transform(rows.where("id = 4")).count() > 0


def test_many_series_do_not_widen_the_vector(spark):
    """50,000 ids: no list of ids, no place of its own for each."""
    rows = spark.range(50_000).select(F.concat(F.lit("s"), "id").alias("id"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 * 2.0).alias("y"))
    pipe = features.FeaturePipeline(["x"], ["id"]).fit(rows)
    ready = pipe.transform(rows)
    assert tuning.vector_width(ready) == 65
    assert not any("Indexer" in type(s).__name__ or "OneHot" in type(s).__name__ for s in pipe.stages)
    model = gm.fit_global(rows, "gbt", ["x"], ["id"], maxIter=2, maxDepth=3)
    assert tuning.score_row(model.transform(rows), "y")["rsq"] > 0.99
    unseen = spark.createDataFrame([("new", 3.0)], "id string, x double")
    assert model.transform(unseen).first()["prediction"] == pytest.approx(6.0, abs=0.5)


def test_boosting_ends_early(rows):
    train = rows.where("split = 'train'").withColumn("y", F.rand(3))  # nothing to learn
    early = gm.fit_global(train, "gbt", PREDICTORS, ["id"], stop=0.05, maxIter=30, maxDepth=3)
    late = gm.fit_global(train, "gbt", PREDICTORS, ["id"], maxIter=30, maxDepth=3)
    assert gm.rounds_used(late) == 30 and gm.rounds_used(early) < 15


def test_tuning_goes_on_where_it_ended(spark, rows, tmp_path, monkeypatch):
    folds = calendar.time_folds(rows.where("split = 'train'"), 2)
    grid = tuning.latin_hypercube(spark, {"minInstancesPerNode": (1, 30)}, 3, seed=1)
    options = {"fixed": {"numTrees": 3}, "log": str(tmp_path / "scores"), "parallelism": 1}
    done = []
    score = tuning.score_row
    monkeypatch.setattr(tuning, "score_row", lambda *a: done.append(1) or score(*a))

    def broken(*a):
        if len(done) == 4:
            raise RuntimeError("the driver is gone")
        return done.append(1) or score(*a)

    monkeypatch.setattr(tuning, "score_row", broken)
    with pytest.raises(Exception, match="the driver is gone"):
        tuning.tune(folds, "rf", grid, PREDICTORS, ["id"], **options)
    monkeypatch.setattr(tuning, "score_row", lambda *a: done.append(1) or score(*a))
    out = tuning.tune(folds, "rf", grid, PREDICTORS, ["id"], **{**options, "parallelism": 3})
    assert len(done) == 6 and [r["n"] for r in out.collect()] == [2, 2, 2]
    again = tuning.tune(folds, "rf", grid, PREDICTORS, ["id"], **options)
    assert len(done) == 6 and sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_rounds_narrow_their_ranges(spark, rows):
    folds = calendar.time_folds(rows.where("split = 'train'"), 2)
    out = tuning.tune_rounds(folds, "rf", {"minInstancesPerNode": (1, 40)}, PREDICTORS, ["id"], points=(4, 3, 2), top=2, fixed={"numTrees": 3}).collect()
    assert [sum(r["round"] == k for r in out) for k in (1, 2, 3)] == [4, 3, 2]
    for k in (2, 3):
        best = sorted((r for r in out if r["round"] == k - 1), key=lambda r: (-r["rsq"], r["config_id"]))[:2]
        low, high = sorted(r["minInstancesPerNode"] for r in best)
        assert all(low <= r["minInstancesPerNode"] <= high for r in out if r["round"] == k)


def test_boosted_errors_see_lags_and_regressors(spark, rows):
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    _, boost, combined = gm.fit_arima_boost(train.select("id", "ds", "y"), 12, ["id"], features=(train, test), predictors=PREDICTORS, maxIter=3, maxDepth=3)
    assert combined.select("id", "ds").distinct().count() == 48
    assert boost.stages[-2].getInputCols()[: len(PREDICTORS)] == PREDICTORS


def test_one_permutation_for_any_layout(rows, model):
    test = rows.where("split = 'test'")
    got = [sorted(map(tuple, explain.permutation_importance(model, test.repartition(n), ["y_lag1", "y_lag6"]).collect())) for n in (1, 7)]
    assert [r[0] for r in got[0]] == [r[0] for r in got[1]]
    assert np.allclose([r[1:] for r in got[0]], [r[1:] for r in got[1]], rtol=1e-9)
    order = [F.xxhash64("id", "ds", F.lit(0)), F.col("id"), F.col("ds")]
    ranked = explain._ranked(test.repartition(5), order).orderBy("_r").collect()
    assert [r["_r"] for r in ranked] == list(range(48))
    plain = test.orderBy(*order).collect()
    assert [(r["id"], r["ds"]) for r in ranked] == [(r["id"], r["ds"]) for r in plain]


def test_surrogate_equals_weighted_least_squares(spark, rows, model):
    test, names = rows.where("split = 'test' AND id = 2"), ["y_lag1", "y_lag2", "sin12_k1"]
    got = {(r["ds"], r["feature"]): (r["effect"], r["intercept"]) for r in explain.local_surrogate(model, test, rows, names, k=3, n=60).collect()}
    assert len(got) == 12 * 3
    # the same rows, fitted one observation at a time
    sd = rows.agg(*[F.stddev_samp(f).alias(f) for f in names]).first()
    base = {r["ds"]: r for r in test.collect()}
    drawn = test.select("*", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("_i"))
    u, v = (lambda f: tuning.unit_draw(F.col("id"), F.col("ds"), F.col("_i"), F.lit(f), F.lit(0))), (lambda f: tuning.unit_draw(F.col("id"), F.col("ds"), F.col("_i"), F.lit(f), F.lit(1)))
    z = {f: F.when(F.col("_i") == 0, 0.0).otherwise(F.sqrt(-2 * F.ln(1 - u(f))) * F.cos(2 * np.pi * v(f))) for f in names}
    moved = drawn.withColumns({f"z_{f}": z[f] for f in names}).withColumns({f: F.col(f) + F.col(f"z_{f}") * sd[f] for f in names})
    scored = model.transform(moved).select("ds", *[f"z_{f}" for f in names], "prediction").toPandas()
    for day, part in scored.groupby("ds"):
        x = part[[f"z_{f}" for f in names]].to_numpy()
        w = np.sqrt(np.exp(-(x * x).sum(axis=1) / (2 * 0.75**2 * 3)))
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]) * w[:, None], part["prediction"].to_numpy() * w, rcond=None)[0]
        assert day in base
        for f, b in zip(names, beta[1:]):
            assert got[day, f] == (pytest.approx(b, abs=1e-9), pytest.approx(beta[0], abs=1e-9))
