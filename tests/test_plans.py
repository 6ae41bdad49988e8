"""What the physical plans must and must not contain."""

import re

import pytest
from conftest import panel

from seriesloom import plans
from seriesloom.operators import diagnostics, ordered
from seriesloom.plans import bindings as b


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


NO_PYTHON = ["rollup_region", "rolling_mean", "acf", "accuracy", "select_best", "ensemble_weighted", "profile", "calendar_features", "anomalies", "scenario_compare"]


@pytest.mark.parametrize("name", NO_PYTHON)
def test_no_python_and_no_cross_join(spark, sf, name):
    text = physical(plans.queries()[name](spark, sf))
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_what_is_used(spark, sf):
    text = physical(plans.queries()["profile"](spark, sf))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all("l_shipdate" not in s and "l_orderkey" not in s for s in schemas)


def test_filters_reach_the_scan(spark, sf):
    df = plans.queries()["filter_predicates"](spark, sf)
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    pushed = next(line for line in text.splitlines() if "PushedFilters" in line)
    assert "EqualTo(o_orderstatus,F)" in pushed and "GreaterThan(o_orderdate" in pushed


def test_lags_and_rolling_means_share_one_shuffle(spark):
    p = panel(spark, {1: range(20), 2: range(20)})
    text = physical(ordered.add_rolling(ordered.add_lags(p, range(1, 7)), "y_lag6", range(1, 7)))
    assert text.count("Exchange") == 1


def test_orders_are_summed_before_the_join(spark, sf):
    text = physical(b.panel(spark, sf))
    assert text.index("Join") < text.rindex("partial_sum")
    assert text.count("partial_sum") >= 2


def test_windows_over_panels_are_partitioned(spark):
    p = panel(spark, {1: range(30), 2: range(30)})
    for df in (ordered.interpolate(p, "y"), diagnostics.anomalies(p), diagnostics.acf(p, 3), ordered.tail_n(p, 3)):
        text = physical(df)
        assert "Window" in text and "SinglePartition" not in text
