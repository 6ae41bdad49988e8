import numpy as np
import pytest
from conftest import months, panel
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom.functions.quantiles import exact_quantiles
from seriesloom.operators import blend, calendar, cleaning, diagnostics, evaluate, features, ordered, reshape, rollup


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-5, 5), st.floats(-1e6, 1e6)), min_size=1, max_size=60), st.integers(1, 64))
def test_quantiles_equal_numpy(spark, values, cells):
    df = spark.createDataFrame([(1, float(v)) for v in values] + [(2, 7.0), (1, None)], "g int, v double")
    probs = {"a": 0.0, "b": 0.3, "c": 0.5, "d": 0.95, "e": 1.0}
    rows = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", probs, cells).collect()}
    for name, p in probs.items():
        assert rows[1][name] == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-9)
        assert rows[2][name] == 7.0
    assert rows[1]["n"] == len(values)


def test_hot_group_quantile(spark):
    df = spark.range(60_000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.pmod(F.xxhash64("id"), F.lit(10_000)).cast("double").alias("v"))
    df = df.withColumn("g", F.when(F.col("v") < 9_000, 0).otherwise(F.col("g")))
    pdf = df.toPandas()
    rows = {r["g"]: r["m"] for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}, 64).collect()}
    assert rows == pdf.groupby("g")["v"].median().to_dict()


def test_quantile_with_far_outliers(spark):
    df = spark.range(20_001).select(F.lit(1).alias("g"), F.when(F.col("id") == 0, 1e300).otherwise(F.col("id") / 7.0).alias("v"))
    row = exact_quantiles(df, ["g"], "v", {"m": 0.5, "top": 1.0}, 64).first()
    assert row["m"] == pytest.approx(10_001 / 7.0) and row["top"] == 1e300


def test_gaps_are_padded_before_lags(spark):
    p = spark.createDataFrame([(1, m, v) for m, v in zip([months(4)[i] for i in (0, 1, 3)], (1.0, 2.0, 4.0))], "id int, ds date, y double")
    full = calendar.pad_calendar(p)
    assert [r["y"] for r in full.orderBy("ds").collect()] == [1.0, 2.0, 0.0, 4.0]
    lagged = ordered.add_lags(full, [2]).orderBy("ds").collect()
    assert [r["y_lag2"] for r in lagged] == [None, None, 1.0, 2.0]
    open_gap = full.withColumn("y", F.nullif("y", F.lit(0.0)))
    assert [r["y"] for r in ordered.interpolate(open_gap, "y").orderBy("ds").collect()] == [1.0, 2.0, 3.0, 4.0]


def test_padding_reaches_common_bounds(spark):
    p = panel(spark, {1: [1.0, 2.0]}).unionByName(panel(spark, {2: [5.0]}, "2000-04"))
    rows = calendar.pad_calendar(p).orderBy("id", "ds").collect()
    assert [(r["id"], r["y"]) for r in rows] == [(1, 1.0), (1, 2.0), (1, 0.0), (1, 0.0), (2, 0.0), (2, 0.0), (2, 0.0), (2, 5.0)]


def test_even_period_frame(spark):
    rows = ordered.add_rolling(panel(spark, {1: [1, 2, 3, 4, 5]}), "y", [4]).orderBy("ds").collect()
    # one row back, two rows ahead, partial at the edges
    assert [r["y_roll4"] for r in rows] == [2.0, 2.5, 3.5, 4.0, 4.5]


def test_constant_series(spark):
    p = panel(spark, {1: [3.0] * 5})
    assert all(r["z"] is None for r in features.standardize(p).collect())
    assert "y" in features.zero_variance(p)


def test_inverse_of_transform(spark):
    p = panel(spark, {1: [1, 10, 100], 2: [5, 6, 9]})
    params = rollup.scale_params(p)
    z = rollup.attach_params(p, params).select("id", "ds", "y", ((F.log1p("y") - F.col("mean_log")) / F.col("sd_log")).alias("value"))
    for r in blend.invert_forecast(z, params).collect():
        assert r["value"] == pytest.approx(r["y"])


def test_positions_over_several_ranges(spark):
    df = spark.range(500).select((F.col("id") % 100).alias("c"), F.pmod(F.xxhash64(F.col("id") % 100), F.lit(50)).cast("double").alias("y"))
    rows = ordered.reorder_category(df, "c", "y").orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(1, 101))
    assert [(-r["y"], r["c"]) for r in rows] == sorted((-r["y"], r["c"]) for r in rows)


def test_top_k_keeps_ties(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([9, 7, 7, 7, 1])], "id int, y double")
    assert sorted((r["y"], r["rank"]) for r in ordered.top_k(df, 2).collect()) == [(7.0, 2), (7.0, 2), (7.0, 2), (9.0, 1)]


def test_ties_go_to_the_lower_model(spark):
    acc = spark.createDataFrame([(1, 2, 5.0), (1, 1, 5.0), (2, 1, 9.0), (2, 2, 3.0), (2, 3, None)], "id int, model_id int, rmse double")
    assert {r["id"]: r["model_id"] for r in evaluate.select_best(acc).collect()} == {1: 1, 2: 2}


def test_ensemble_of_one_is_itself(spark):
    f = spark.createDataFrame([(1, months(1)[0], 1, "A", 4.0)], "id int, ds date, model_id int, model_desc string, value double")
    assert blend.ensemble(f).first()["value"] == 4.0
    w = spark.createDataFrame([(1, 0.2)], "model_id int, weight double")
    assert blend.ensemble(f, "weighted", w).first()["value"] == pytest.approx(4.0)


def test_sine_autocorrelation(spark):
    t = np.arange(60)
    rows = diagnostics.acf(panel(spark, {1: np.sin(2 * np.pi * t / 12)}), 12).orderBy("lag").collect()
    assert rows[11]["acf"] == pytest.approx(1 - 12 / 60, abs=0.02)


def ar1(n=500, phi=0.7, seed=3):
    rng = np.random.default_rng(seed)
    out = [0.0]
    for _ in range(n - 1):
        out.append(phi * out[-1] + rng.normal())
    return out


def test_pacf_of_ar1(spark):
    rows = diagnostics.pacf(panel(spark, {1: ar1()}, "1900-01"), 6).orderBy("lag").collect()
    assert rows[0]["pacf"] == pytest.approx(0.7, abs=0.1)
    assert all(abs(r["pacf"]) < 2 * r["band"] for r in rows[1:])


def test_chi2_tail_for_odd_and_even_degrees(spark):
    from seriesloom.functions.tails import chi2_tail

    row = spark.range(1).select(chi2_tail(F.lit(3.841459), 1).alias("a"), chi2_tail(F.lit(7.814728), 3).alias("b"), chi2_tail(F.lit(21.02607), 12).alias("c")).first()
    assert [round(v, 5) for v in row] == [0.05, 0.05, 0.05]


def test_regression_recovers_a_line(spark):
    p = panel(spark, {1: [2 * t + 5 for t in range(36)]})
    row = diagnostics.trend_regression(p).first()
    assert row["slope"] == pytest.approx(2.0) and row["rsq"] == pytest.approx(1.0)
    fit = diagnostics.ts_regression(features.add_calendar(ordered.add_lags(p, [1])), ["y_lag1"]).collect()
    assert {r["term"]: round(r["estimate"], 6) for r in fit} == {"y_lag1": 1.0, "(Intercept)": 2.0}


def test_loess_on_a_line_and_refusal(spark):
    df = spark.createDataFrame([(float(x), 3.0 * x) for x in range(20)], "x double, y double")
    assert all(r["smooth"] == pytest.approx(r["y"]) for r in diagnostics.loess(df, "x", "y", 0.5).collect())
    with pytest.raises(Exception, match="n_points"):
        diagnostics.loess(df, "x", "y", 0.5, n_points=10).collect()


def test_correlation_filter():
    pairs = [("a", "b", 0.99), ("a", "c", 0.2), ("b", "c", 0.4)]
    assert features.correlated_columns(pairs) == ["b"]


def test_arrays_round_trip(spark):
    p = panel(spark, {1: [1, 2, 3], 2: [4, 5]})
    back = reshape.from_arrays(reshape.to_arrays(p, dates=True))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, p.collect()))


def test_kfold_is_balanced_and_repeats(spark):
    p = panel(spark, {i: range(60) for i in range(20)})
    one, two = (calendar.kfold(p, 6, seed=5).groupBy("fold").count().orderBy("fold").collect() for _ in range(2))
    assert one == two and len(one) == 6
    assert all(150 < r["count"] < 250 for r in one)


def test_drop_thin_tail(spark):
    p = panel(spark, {1: range(30)})
    volume = p.select("ds", F.when(F.col("y") >= 28, 2).otherwise(100).alias("n"))
    assert cleaning.drop_thin_tail(p, volume).count() == 28


def test_weekly_labels(spark):
    row = features.add_calendar(panel(spark, {1: [1.0]}, "2023-01")).first()
    assert (row["wday_lbl"], row["wday"], row["year_iso"], row["qday"]) == ("Sunday", 1, 2022, 1)
