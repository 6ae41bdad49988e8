"""Series, months and lines that must not vanish: each comes out, or says why not."""

import datetime as dt

import pytest
from conftest import months, panel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer

from seriesloom.operators import global_models as gm
from seriesloom.operators import rollup
from seriesloom.operators import series_models as sm
from seriesloom.sources import statements


def rule(text):
    """A model that predicts by an expression over the feature columns."""
    return PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, {text} AS prediction FROM __THIS__")])


def test_recursion_reaches_as_far_as_its_lags(spark):
    ahead = gm.recursive_forecast(rule("y_lag30"), panel(spark, {1: range(60)}), 3, lags=[30]).orderBy("ds").collect()
    assert [r.value for r in ahead] == [30.0, 31.0, 32.0]


def test_short_series_say_so(spark):
    p = panel(spark, {1: range(30), 2: range(5), 3: range(3)})
    with pytest.raises(ValueError, match="the lags need 6"):
        gm.recursive_forecast(rule("y_lag6"), p, 2)
    got = gm.recursive_forecast(rule("coalesce(y_lag6_roll3, 0D)"), p, 2, periods=[3], status=True).collect()
    assert sorted((r.id, r.status) for r in got) == [(1, "ok"), (1, "ok"), (2, "too short: 5 of 6 months"), (3, "too short: 3 of 6 months")]


def test_an_ensemble_is_refitted_by_its_members(spark):
    arrays = sm.series_arrays(panel(spark, {1: range(10, 60), 2: range(50)}))
    chosen = spark.createDataFrame([(1, 100), (2, 2)], "id int, model_id int")
    fits = {r.id: r for r in sm.nested_fit(arrays, ("trend_season", "arima"), 4, chosen).collect()}
    single = [r.ahead for r in sm.nested_fit(arrays.where("id = 1"), ("trend_season", "arima"), 4).collect()]
    assert (fits[1].model_id, fits[1].status, fits[2].model_id) == (100, "ok", 2)
    assert fits[1].ahead == pytest.approx([sum(v) / 2 for v in zip(*single)])


def test_regressors_are_laid_out_by_month(spark):
    p = panel(spark, {1: range(24)}).withColumnRenamed("y", "v").selectExpr("id", "ds", "v AS y", "v AS rate")
    future = spark.createDataFrame([(1, dt.date(2002, 1, 1), 1.0), (1, dt.date(2002, 3, 1), 3.0)], "id int, ds date, rate double")
    row = sm.series_arrays(p, ["rate"], future).first()
    assert row.x_ahead == [[1.0, None, 3.0]]
    fit = sm.fit_trend_season(sm.series_arrays(p, ["rate"], future, h=3), 3).first()
    assert fit.status == "error" and "all months of the horizon" in fit.message
    alone = sm.fit_arima(sm.series_arrays(p, ["rate"], future.where("id = 2"), h=3), 3).first()
    assert alone.status == "error" and "no future regressors" in alone.message


def test_gaps_repeats_and_odd_numbers_are_errors(spark):
    m = months(30)
    rows = [(1, d, 1.0 + i) for i, d in enumerate(m) if i != 7] + [(2, d, 2.0) for d in [*m, m[3]]] + [(3, d, float("nan") if i == 4 else i + 1.0) for i, d in enumerate(m)] + [(4, d, i % 5 + 1.0) for i, d in enumerate(m)]
    arrays = sm.series_arrays(spark.createDataFrame(rows, "id int, ds date, y double"))
    for models in (("trend_season",), ("arima",), ("ets",)):
        got = {r.id: (r.status, r.message) for r in sm.nested_fit(arrays, models, 3).collect()}
        # ARIMA's likelihood takes months without a value
        gap = "ok" if models == ("arima",) else "error"
        assert {i: s for i, (s, _) in got.items()} == {1: gap, 2: "error", 3: gap, 4: "ok"}
        assert (gap == "ok" or "1 months have no value" in got[1][1]) and "months repeat" in got[2][1]


def test_sums_keep_small_values_and_show_odd_ones(spark):
    small = spark.createDataFrame([(1, 0.004)] * 100 + [(2, float("nan")), (2, 5.0)], "id int, y double")
    got = {r.id: r.y for r in rollup.agg_panel(small, ["id"], ["y"]).collect()}
    assert got[1] == pytest.approx(0.4) and got[2] != got[2]


def test_short_and_quoted_lines_are_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text('A first; line\nUNITS\n"DATA_BASE";CODMUN_IBGE;VERBETE_160;VERBETE_167\n202001;"35;001";10.5;1\n202002;35001\n"202003";35002;1;2;9\n\nTOTAL;3\n')
    lines = statements.read_lines(spark, str(tmp_path))
    got = statements.parse_lines(lines, skip=2).orderBy("data_base").drop("file").collect()
    assert [tuple(r) for r in got] == [("202001", "35;001", "10.5", "1"), ("202002", "35001", None, None), ("202003", "35002", "1", "2")]
    assert sorted(r.line for r in statements.rejected_lines(lines, skip=2).collect()) == ['"202003";35002;1;2;9', "TOTAL;3"]


def test_surplus_fields_are_listed(spark, tmp_path):
    rows = ['199501;"1;x";2;3', '199502;"1";2;3;EXTRA;77', "199503;1;2;3;;", '199504;1;2;3;"a;b"', "199505;1"]
    (tmp_path / "a.csv").write_text('top\nUNITS\n"DATA_BASE";"COD;MUN";VERBETE_1;VERBETE_2\n' + "\n".join(rows) + "\n")
    lines = statements.read_lines(spark, str(tmp_path))
    got = statements.parse_lines(lines, skip=2).orderBy("data_base").drop("file")
    assert got.columns == ["data_base", "cod_mun", "verbete_1", "verbete_2"]
    assert [tuple(r) for r in got.collect()] == [("199501", "1;x", "2", "3"), ("199502", "1", "2", "3"), ("199503", "1", "2", "3"), ("199504", "1", "2", "3"), ("199505", "1", None, None)]
    assert sorted(r.line for r in statements.rejected_lines(lines, skip=2).collect()) == [rows[1], rows[3]]
