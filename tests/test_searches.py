"""Nearest series, medoids, linked groups and quantiles at the sizes where their short cuts matter."""

import itertools
import struct

import numpy as np
import pytest
from conftest import panel
from pyspark.sql import functions as F

from seriesloom.functions import distances as ds
from seriesloom.functions.quantiles import exact_quantiles
from seriesloom.functions.warping import Counter, Warping
from seriesloom.operators import clustering as cl
from seriesloom.operators import similarity as si


def vectors(spark, points):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id int, a array<double>")


def waves(n, length=36, kinds=6, seed=3):
    """Series of a few shapes, each with its own noise."""
    rng = np.random.default_rng(seed)
    shapes = rng.normal(size=(kinds, length)).cumsum(axis=1)
    rows = shapes[rng.integers(0, kinds, n)] + rng.normal(scale=0.4, size=(n, length))
    return (rows - rows.mean(1, keepdims=True)) / rows.std(1, keepdims=True)


STEPS = [(None, 2.0), (None, 1.0), (4, 2.0), (4, 1.0), (0, 1.0), (3, 1.5)]


@pytest.mark.parametrize("window,diagonal", STEPS)
def test_bounds_and_diagonals_equal_the_full_recursion(window, diagonal):
    x, y = waves(20, seed=1), waves(25, seed=2)
    full = ds.dtw(window, diagonal)(x, y)
    metric = Warping(window, diagonal)
    assert (metric.bound(x, y) <= full + 1e-9).all()
    i, j = (g.ravel() for g in np.indices(full.shape))
    assert np.allclose(metric.exact(x[i], y[j], np.full(len(i), np.inf)), full.ravel())
    limit = np.full(len(i), np.median(full))
    got = metric.exact(x[i], y[j], limit)
    near = full.ravel() <= limit
    assert np.allclose(got[near], full.ravel()[near]) and (got[~near] > limit[~near]).all() and np.isinf(got).any()


@pytest.mark.parametrize("window,diagonal", STEPS[:4])
def test_within_and_nearest_equal_the_full_table(spark, window, diagonal):
    rows = waves(70)
    rows[5] = rows[6]  # an equal pair, and ties with every other
    full = ds.dtw(window, diagonal)(rows, rows)
    v, metric = vectors(spark, rows), Warping(window, diagonal)
    eps = np.quantile(full, 0.1)
    got = {(r.id_a, r.id_b): r.dist for r in si.within(v, metric, eps, block=16).collect()}
    want = {(i, j): full[i, j] for i, j in itertools.combinations(range(70), 2) if full[i, j] <= eps}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)
    for block in (16, 256):
        near = sorted((r.id, r.rank, r.other) for r in si.nearest(v, metric, 3, block).collect())
        order = [sorted((round(full[i, j], 9), j) for j in range(70) if j != i)[:3] for i in range(70)]
        assert near == [(i, k + 1, j) for i in range(70) for k, (_, j) in enumerate(order[i])]


def test_nearest_of_plain_distances(spark):
    rng = np.random.default_rng(8)
    points = rng.integers(0, 6, size=(50, 2)).astype(float)
    full = np.linalg.norm(points[:, None] - points[None], axis=2)
    got = sorted((r.id, r.rank, r.other) for r in si.nearest(vectors(spark, points), ds.euclid, 4, block=8).collect())
    order = [sorted((round(full[i, j], 9), j) for j in range(50) if j != i)[:4] for i in range(50)]
    assert got == [(i, k + 1, j) for i in range(50) for k, (_, j) in enumerate(order[i])]
    assert [r.rank for r in si.nearest(vectors(spark, points[:2]), ds.euclid, 4).collect()] == [1, 1]
    assert si.nearest(vectors(spark, points[:1]), ds.euclid, 4).count() == 0


def test_few_pairs_reach_the_end_of_the_recursion(spark):
    rows = waves(300, kinds=12)
    full = ds.dtw(4, 2.0)(rows, rows)
    pairs = 300 * 299 // 2
    eps = float(np.quantile(full, 0.05))
    counts = si.search_counts(vectors(spark, rows), Warping(4, 2.0), eps, block=64).first()
    assert counts.pairs == pairs and counts.finished <= counts.bounded and counts.finished < pairs / 5
    metric = Warping(4, 2.0, Counter())
    metric.nearest(rows, rows, ~np.eye(300, dtype=bool), 3, np.full(300, np.inf), np.full(300, np.inf))
    assert metric.counter.finished < 300 * 299 / 5



# --- medoids


def plain_pam(d, medoids):
    """For each medoid the best exchange; of these, the best ones together that cost least."""
    medoids = list(medoids)
    cost = lambda m: d[:, m].min(1).sum()
    exchanged = lambda m, x: [*medoids[:m], x, *medoids[m + 1 :]]
    while True:
        now = cost(medoids)
        best = sorted(min((round(cost(exchanged(m, x)) - now, 9), x, m) for x in range(len(d))) for m in range(len(medoids)))
        best = [s for s in best if s[0] < -1e-9 * max(1.0, now)]
        if not best:
            return now
        options, trial = [], list(medoids)
        for _, x, m in best:
            trial = [*trial[:m], x, *trial[m + 1 :]]
            options.append((round(cost(trial), 9), len(options), trial))
        medoids = min(options)[2]


@pytest.mark.parametrize("k,block", [(1, 256), (4, 16)])
def test_swaps_reach_the_cost_of_plain_pam(spark, k, block):
    rng = np.random.default_rng(k)
    points = np.vstack([rng.normal(c, 1.5, size=(12, 3)) for c in (0, 4, 8, 12, 16)])
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    v = vectors(spark, points)
    start = [m[0] for m in cl.spread_start(v, k, ds.euclid, 2)]
    out = cl.kmedoids(v, k, ds.euclid, seed=2, block=block).collect()
    assert all(r.converged for r in out) and len({r.label for r in out}) == k
    assert sum(r.dist for r in out) == pytest.approx(plain_pam(d, start))
    assert all(r.dist == pytest.approx(d[r.id, r.medoid]) for r in out)


def test_distances_without_the_triangle_inequality(spark):
    rows = waves(40, kinds=3)
    d = ds.dtw(None, 2.0)(rows, rows)
    v = vectors(spark, rows)
    start = [m[0] for m in cl.spread_start(v, 3, ds.dtw(None, 2.0), 5)]
    out = cl.kmedoids(v, 3, ds.dtw(None, 2.0), seed=5, metric=False, block=15).collect()
    assert sum(r.dist for r in out) == pytest.approx(plain_pam(d, start))


def test_rings_rule_out_most_comparisons(spark):
    rng = np.random.default_rng(7)
    points = np.vstack([rng.normal(c, 1.0, size=(100, 2)) for c in (0, 40, 80, 120, 160, 200)])
    v = vectors(spark, points)
    seen = cl.with_medoids(v, [(i, points[i].tolist()) for i in range(3, 600, 100)], ds.euclid)
    every = cl.best_swaps(seen, 6, ds.euclid, block=32, metric=False)
    some = cl.best_swaps(seen, 6, ds.euclid, block=32)
    assert every["compared"] == 600 * 600 and some["compared"] < 600 * 600 / 2
    assert some["swaps"] == every["swaps"]


def test_an_early_stop_is_reported(spark):
    rng = np.random.default_rng(1)
    out = cl.kmedoids(vectors(spark, rng.normal(size=(40, 2))), 5, ds.euclid, seed=3, max_passes=0)
    assert {r.converged for r in out.collect()} == {False}


# --- linked groups


def plain_groups(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("seed", range(2))
def test_stars_connect_what_edges_connect(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 60, size=(35, 2))] + [(i, i + 1) for i in range(60, 90)] + [(95, i) for i in range(96, 120)] + [(7, 7)]
    for few in (0, 200_000):  # contracted to the end, and finished by one task
        got = {r.id: r.label for r in cl.connected(spark.createDataFrame(edges, "id_a int, id_b int"), spark.range(121).selectExpr("int(id) AS id"), few).collect()}
        assert [got[i] for i in range(121)] == plain_groups(121, edges)
    none = spark.createDataFrame([], "id_a int, id_b int")
    assert {(r.id, r.label) for r in cl.connected(none, spark.range(3).selectExpr("int(id) AS id")).collect()} == {(0, 0), (1, 1), (2, 2)}


@pytest.mark.parametrize("block", [9, 256])
def test_forest_connects_like_all_links_with_few_of_them(spark, block):
    rng = np.random.default_rng(4)
    points = np.vstack([rng.normal(c, 1.0, size=(25, 2)) for c in (0, 9, 18)])
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    v = vectors(spark, points)
    links = [(i, j) for i, j in itertools.combinations(range(75), 2) if d[i, j] < 3.0]
    edges = [(r.id_a, r.id_b) for r in cl.forest(v, ds.euclid, lambda m: m < 3.0, block).collect()]
    assert set(edges) <= set(links) and plain_groups(75, edges) == plain_groups(75, links)
    if block == 256:  # one tile: a forest has fewer links than series
        assert len(edges) < 75 < len(links)
    got = {r.id: r.label for r in cl.connected(cl.forest(v, ds.euclid, lambda m: m < 3.0, block), v.select("id")).collect()}
    assert [got[i] for i in range(75)] == plain_groups(75, links)


def test_pvalue_groups_hold_no_pair_rows(spark):
    rng = np.random.default_rng(4)
    p = panel(spark, {i: rng.normal(size=120) for i in range(12)}, "1990-01")
    arrays, kernel = si.feature_arrays(p, "ar", order=1)
    assert cl.forest(arrays, kernel, lambda m: m > -1.0).count() == 11
    assert {r.label for r in cl.cluster_pvalue(arrays, kernel, -1.0).collect()} == {0}


# --- quantiles


def test_a_tight_group_with_a_far_outlier_is_divided(spark):
    df = spark.range(40_001).select(F.lit(None).cast("int").alias("g"), F.when(F.col("id") == 0, 1e12).otherwise(1_000_000 + F.col("id") / 400.0).alias("v"))
    df = df.unionByName(spark.createDataFrame([(1, 5.0), (1, None), (2, None)], "g int, v double"))
    rows = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"m": 0.5, "top": 1.0, "low": 0.0}, small=100).collect()}
    assert rows.keys() == {None, 1} and rows[1].m == 5.0
    assert (rows[None].n, rows[None].m, rows[None].top, rows[None].low) == (40_001, 1_000_000 + 20_001 / 400, 1e12, 1_000_000 + 1 / 400)


def test_no_task_orders_more_than_the_bound(spark, monkeypatch):
    """A million values between neighbours of 10^6 and one at 10^12: the cells that are ordered stay below the bound."""
    from seriesloom.functions import quantiles as q

    ordered = []
    hits = q._hits
    monkeypatch.setattr(q, "_hits", lambda rows, cell, probs: ordered.append(rows.groupBy(*cell).count().agg(F.max("count")).first()[0]) or hits(rows, cell, probs))
    df = spark.range(1_000_001).select(F.when(F.col("id") == 7, 1e12).otherwise(1_000_000 + F.col("id") / 1e4).alias("v"))
    row = exact_quantiles(df, [], "v", {"m": 0.5, "q": 0.9}).first()
    assert row.m == pytest.approx(1_000_050.0, abs=1e-3) and row.q == pytest.approx(1_000_090.0, abs=1e-3)
    assert ordered and max(ordered) <= q.SMALL


def test_keys_keep_the_order_of_doubles(spark):
    from seriesloom.functions.quantiles import _with_key

    rng = np.random.default_rng(2)
    bits = rng.integers(0, 0x7FF0000000000000, 4000)
    values = [struct.unpack("d", struct.pack("q", int(b)))[0] for b in bits]
    values += [-v for v in values[:2000]] + [0.0, -0.0, float("inf"), -float("inf"), float("nan"), 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308]
    values += [f(2.0**e) for e in range(-1074, 1024) for f in (lambda v: v, lambda v: np.nextafter(v, np.inf), lambda v: np.nextafter(v, 0))]
    values = [float(v) for v in values]
    rows = _with_key(spark.createDataFrame([(v,) for v in values], "_v double")).orderBy("_v").collect()
    keys = [r._key for r in rows]
    assert keys == sorted(keys)
    # two neighbours may share a key, no more than two
    assert max(np.unique([r._key for r in _with_key(spark.createDataFrame([(v,) for v in set(values)], "_v double")).collect()], return_counts=True)[1]) <= 2
