import numpy as np
import pytest
from conftest import panel

from seriesloom.functions import arima, kernels
from seriesloom.operators import calendar, series_models as sm


@pytest.fixture(scope="module")
def fits(spark):
    t = np.arange(60)
    p = panel(spark, {1: 2 * t + 5.0, 2: 50 + t + 10 * np.sin(2 * np.pi * t / 12)})
    out = {}
    for name, (_, fit) in sm.FAMILIES.items():
        out[name] = {r["id"]: r for r in fit(sm.series_arrays(p), 12).collect()}
    return out


@pytest.mark.parametrize("name", ["trend_season", "arima", "ets", "tbats"])
def test_line_is_recovered(fits, name):
    want = 2 * np.arange(60, 72) + 5.0
    assert fits[name][1]["status"] == "ok"
    assert np.allclose(fits[name][1]["ahead"], want, rtol=0.03)


@pytest.mark.parametrize("name", ["trend_season", "arima", "ets", "tbats"])
def test_season_is_recovered(fits, name):
    t = np.arange(60, 72)
    want = 50 + t + 10 * np.sin(2 * np.pi * t / 12)
    assert np.abs(np.array(fits[name][2]["ahead"]) - want).max() < 4.0


def simulate(ar=(), ma=(), sar=(), sma=(), n=600, m=12, seed=0):
    shape = arima.Shape(4, 2, m)
    theta = np.zeros((1, shape.size))
    for at, values in zip((0, 4, 8, 10), (ar, ma, sar, sma)):
        theta[0, at : at + len(values)] = values
    left, right = (w[0] for w in shape.polynomials(theta))
    rng = np.random.default_rng(seed)
    e, y = rng.normal(size=n + 200), np.zeros(n + 200)
    for t in range(n + 200):
        back = min(t, len(left) - 1)
        y[t] = e[t] + left[1 : back + 1] @ y[t - back : t][::-1] + right[1 : back + 1] @ e[t - back : t][::-1]
    return y[200:]


def active_of(shape, *order):
    return shape.active(*order)[None, :]


ORDERS = [
    ({"ar": (0.7,)}, (1, 0, 0, 0), {0: 0.7}),
    ({"ma": (0.6,)}, (0, 1, 0, 0), {4: 0.6}),
    ({"ar": (0.3, -0.2, 0.1, 0.5)}, (4, 0, 0, 0), {0: 0.3, 1: -0.2, 2: 0.1, 3: 0.5}),
    ({"ma": (0.2, 0.1, -0.2, 0.5)}, (0, 4, 0, 0), {4: 0.2, 5: 0.1, 6: -0.2, 7: 0.5}),
    ({"sar": (0.3, 0.5)}, (0, 0, 2, 0), {8: 0.3, 9: 0.5}),
    ({"sma": (0.2, 0.5)}, (0, 0, 0, 2), {10: 0.2, 11: 0.5}),
]


@pytest.mark.parametrize("made,order,want", ORDERS)
@pytest.mark.parametrize("gaps", [False, True])
def test_orders_are_recovered(made, order, want, gaps):
    shape = arima.Shape(4, 2, 12)
    y = simulate(**made, n=700)[None, :]
    if gaps:
        y[0, np.random.default_rng(1).choice(700, 100, replace=False)] = np.nan
    else:
        theta, _, _ = arima.conditional_fit(y, np.zeros((1, 0, 700)), active_of(shape, *order), shape)
        assert all(theta[0, j] == pytest.approx(v, abs=0.12) for j, v in want.items())
    theta, *_ = arima.exact_fit(y[:, None, :], np.zeros((1, shape.size)), active_of(shape, *order), shape, np.zeros(0), np.zeros((1, 0, 3)))
    assert all(theta[0, j] == pytest.approx(v, abs=0.12) for j, v in want.items())
    assert np.count_nonzero(theta) == sum(order)


def normal_deviance(y, cov):
    """-2 log likelihood with the best scale, from the whole covariance matrix."""
    n = len(y)
    inner = y @ np.linalg.solve(cov, y)
    return n * np.log(2 * np.pi * inner / n) + np.linalg.slogdet(cov)[1] + n


@pytest.mark.parametrize("gaps", [False, True])
def test_likelihood_equals_the_multivariate_normal(gaps):
    phi, n = 0.6, 60
    shape = arima.Shape(1, 1, 4)
    y = simulate(ar=(phi,), n=n, m=4, seed=3)
    seen = np.ones(n, bool)
    if gaps:
        seen[[3, 4, 20, 41]] = False
    cov = phi ** np.abs(np.subtract.outer(np.arange(n), np.arange(n))) / (1 - phi**2)
    theta = np.zeros((1, shape.size))
    theta[0, 0] = phi
    data = np.where(seen, y, np.nan)[None, None, :]
    none = np.zeros((1, shape.size), bool)
    _, _, deviance, used, ahead, _ = arima.exact_fit(data, theta, none, shape, np.zeros(0), np.zeros((1, 0, 2)))
    assert used[0] == seen.sum() and deviance[0] == pytest.approx(normal_deviance(y[seen], cov[np.ix_(seen, seen)]), rel=1e-9)
    assert ahead[0] == pytest.approx([phi * y[-1], phi**2 * y[-1]])


@pytest.mark.parametrize("d,D", [(1, 0), (0, 1), (1, 1), (2, 0)])
def test_levels_give_the_fit_of_the_differences(d, D):
    """Without gaps, the filter with unknown first levels equals the filter of the differenced series."""
    shape, m, n = arima.Shape(1, 1, 4), 4, 80
    w = simulate(ar=(0.5,), n=n, m=m, seed=5)
    y = w
    for _ in range(d):
        y = np.cumsum(y)
    for _ in range(D):
        for t in range(m, n):
            y[t] += y[t - m]
    x = np.random.default_rng(2).normal(size=n + 3)
    y = y + 2 * x[:n]
    active = active_of(shape, 1, 0, 0, 0)
    cut = lambda v: kernels.difference(v, d, D, m)
    one = arima.exact_fit(np.stack([cut(y), cut(x[:n])])[None], np.zeros((1, shape.size)), active, shape, np.zeros(0), cut(x)[None, None, -3:])
    two = arima.exact_fit(np.stack([y, x[:n]])[None], np.zeros((1, shape.size)), active, shape, arima.difference_weights(d, D, m), x[None, None, n:])
    assert two[0] == pytest.approx(one[0], abs=1e-3) and two[1] == pytest.approx(one[1], abs=1e-3) and one[1][0, 0] == pytest.approx(2, abs=0.4)
    assert two[2] == pytest.approx(one[2], rel=1e-4) and (one[3] == two[3]).all()
    assert two[4][0] == pytest.approx(kernels.undifference(y, one[4][0], d, D, m), rel=1e-3, abs=0.05)


def test_missing_months_are_fitted(spark):
    t = np.arange(72)
    y = 50 + t + 10 * np.sin(2 * np.pi * t / 12) + np.random.default_rng(0).normal(scale=0.3, size=84)[:72]
    p = panel(spark, {1: y, 2: y}).where("id = 1 or month(ds) <> 5 or year(ds) % 2 = 0")
    fits = {r["id"]: r for r in sm.fit_arima(sm.series_arrays(p), 12).collect()}
    ahead = np.arange(72, 84)
    want = 50 + ahead + 10 * np.sin(2 * np.pi * ahead / 12)
    for i in (1, 2):
        assert fits[i]["status"] == "ok" and np.abs(np.array(fits[i]["ahead"]) - want).max() < 3.0
    resid = sm.residual_rows(sm.fit_arima(sm.series_arrays(p), 12))
    assert resid.where("resid IS NULL OR isnan(resid)").count() == 0
    assert resid.where("id = 2 AND month(ds) = 5 AND year(ds) % 2 = 1").count() == 0


def test_a_fourth_lag_is_named_as_it_is(spark):
    y = simulate(ar=(0.0, 0.0, 0.0, 0.8), n=240)
    row = sm.fit_arima(sm.series_arrays(panel(spark, {1: y})), 4, max_pq=4, max_PQ=0).first()
    p, d, q = row["params"][:3]
    assert row["form"].startswith(f"ARIMA({int(p)},{int(d)},{int(q)})") and p == 4 and row["params"][6 + 3] == pytest.approx(0.8, abs=0.15)


def test_regressor_effect_is_found(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=72)
    y = 20 + 5 * x + rng.normal(scale=0.1, size=72)
    p = panel(spark, {1: y}).join(panel(spark, {1: x}).withColumnRenamed("y", "rate"), ["id", "ds"])
    p = calendar.split_last_n(p, 12)
    arrays = sm.series_arrays(p.where("split = 'train'"), ["rate"], p.where("split = 'test'"))
    for name in ("arima", "trend_season"):
        ahead = sm.FAMILIES[name][1](arrays, 12).first()["ahead"]
        assert np.abs(np.array(ahead) - y[60:]).max() < 1.5


def test_smoothing_with_alpha_one_is_the_last_value(spark):
    row = sm.smooth_fixed(panel(spark, {1: [3, 9, 4, 7]}), [1.0]).first()
    assert row["level"] == 7.0
    line = sm.smooth_fixed(panel(spark, {1: [2 * t + 5 for t in range(36)]}), [0.3], beta=0.1).first()
    assert (line["slope"], line["sse"]) == (pytest.approx(2.0), pytest.approx(0.0))


def test_a_failing_series_does_not_stop_the_others(spark):
    p = panel(spark, {1: [5.0], 2: 10 + np.sin(np.arange(40))})
    fits = sm.nested_fit(sm.series_arrays(p), ("trend_season", "arima"), 6)
    errors = {(r["id"], r["model_id"]) for r in sm.error_report(fits).collect()}
    assert errors == {(1, 1), (1, 2)}
    done = {r["id"] for r in sm.forecast_rows(fits).collect()}
    assert done == {2}


def test_differences_are_added_back():
    y = np.cumsum(np.random.default_rng(0).normal(size=50))
    for d, D in ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0)):
        w = kernels.difference(y, d, D, 12)
        ahead = kernels.undifference(y[:40], w[-10:], d, D, 12)
        assert np.allclose(ahead, y[40:])


def test_hold_out_does_not_reach_the_fit(spark):
    base = 10 + np.sin(np.arange(48) / 3)
    other = base.copy()
    other[36:] += 100
    fits = []
    for y in (base, other):
        p = calendar.split_last_n(panel(spark, {1: y}), 12)
        fits.append(sm.fit_ets(sm.series_arrays(p.where("split = 'train'")), 12).first()["ahead"])
    assert fits[0] == fits[1]


def test_future_dates_follow_the_history(spark):
    p = panel(spark, {1: range(1, 31)})
    rows = sm.forecast_rows(sm.fit_trend_season(sm.series_arrays(p), 3)).orderBy("ds").collect()
    assert [str(r["ds"]) for r in rows] == ["2002-07-01", "2002-08-01", "2002-09-01"]
    resid = sm.residual_rows(sm.fit_trend_season(sm.series_arrays(p), 3)).agg({"ds": "max"}).first()[0]
    assert str(resid) == "2002-06-01"
