import itertools

import numpy as np
import pytest
from conftest import panel

from seriesloom.functions import distances as ds
from seriesloom.operators import clustering as cl
from seriesloom.operators import similarity as si


def vectors(spark, points, labels=None):
    labels = labels if labels is not None else [1] * len(points)
    return spark.createDataFrame([(i, [float(v) for v in p], int(c)) for i, (p, c) in enumerate(zip(points, labels))], "id int, a array<double>, label int")


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    points = np.vstack([rng.normal(c, 1.0, size=(14, 3)) for c in (0, 8, 16)])
    return points, np.repeat([1, 2, 3], 14)


def brute_dtw(x, y, window, diagonal):
    n, m = len(x), len(y)
    d = np.full((n, m), np.inf)
    for i, j in itertools.product(range(n), range(m)):
        if window is not None and abs(i - j) > max(window, abs(n - m)):
            continue
        c = abs(x[i] - y[j])
        if i == j == 0:
            d[i, j] = c
            continue
        options = []
        if i:
            options.append(d[i - 1, j] + c)
        if j:
            options.append(d[i, j - 1] + c)
        if i and j:
            options.append(d[i - 1, j - 1] + diagonal * c)
        d[i, j] = min(options)
    return d[-1, -1]


@pytest.mark.parametrize("window,diagonal", [(None, 2.0), (None, 1.0), (3, 2.0), (0, 1.0)])
def test_dtw_equals_brute_force(window, diagonal):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(3, 12)), rng.normal(size=(4, 12))
    got = ds.dtw(window, diagonal)(x, y)
    want = [[brute_dtw(a, b, window, diagonal) for b in y] for a in x]
    assert np.allclose(got, want)


def test_shifted_shape_is_near_under_dtw():
    x = np.sin(np.arange(40) / 4)[None, :]
    y = np.sin((np.arange(40) - 2) / 4)[None, :]
    assert ds.dtw(diagonal=1.0)(x, y)[0, 0] < ds.manhattan(x, y)[0, 0]


def test_small_blocks_cover_every_pair_once(spark, cloud):
    points, _ = cloud
    rows = si.distance_table(vectors(spark, points), ds.euclid, block=5).collect()
    assert len(rows) == len({(r["id_a"], r["id_b"]) for r in rows}) == 42 * 41 // 2
    for r in rows[::17]:
        assert r["id_a"] < r["id_b"]
        assert r["dist"] == pytest.approx(np.linalg.norm(points[r["id_a"]] - points[r["id_b"]]))


@pytest.mark.parametrize("block", [4, 100])
def test_tile_sums_equal_brute_force(spark, cloud, block):
    points, labels = cloud
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    for r in si.tile_sums(vectors(spark, points, labels), ds.euclid, block).collect():
        others = [j for j in range(42) if labels[j] == r["other"] and j != r["id"]]
        row = d[r["id"], others]
        assert (r["n"], r["s"], r["lo"], r["hi"]) == (len(others), pytest.approx(row.sum()), pytest.approx(row.min()), pytest.approx(row.max()))


def test_kmedoids_recovers_groups(spark, cloud):
    points, labels = cloud
    out = {r["id"]: r["label"] for r in cl.kmedoids(vectors(spark, points), 3, ds.euclid, seed=2, block=6).collect()}
    groups = {frozenset(i for i in out if out[i] == c) for c in set(out.values())}
    assert groups == {frozenset(np.nonzero(labels == c)[0].tolist()) for c in (1, 2, 3)}


def test_kmedoids_on_three_shapes(spark):
    t = np.arange(36)
    rng = np.random.default_rng(0)
    shapes = {0: np.sin(t), 1: t / 6.0, 2: -t / 6.0}
    p = panel(spark, {5 * k + i: v + rng.normal(scale=0.05, size=36) for k, v in shapes.items() for i in range(5)})
    arrays, kernel = si.feature_arrays(p, "euclid")
    out = {r["id"]: r["label"] for r in cl.kmedoids(arrays, 3, kernel, seed=3).collect()}
    assert all(len({out[5 * k + i] for i in range(5)}) == 1 for k in range(3)) and len(set(out.values())) == 3


def test_widest_gap_equals_brute_force(spark, cloud):
    points, labels = cloud
    got = {r["label"]: r["widest_gap"] for r in cl.widest_gap(vectors(spark, points, labels), ds.euclid, block=6).collect()}
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    for c in (1, 2, 3):
        members = np.nonzero(labels == c)[0].tolist()
        inside, edges = {members[0]}, []
        while len(inside) < len(members):
            w, j = min((d[i, j], j) for i in inside for j in members if j not in inside)
            inside.add(j)
            edges.append(w)
        assert got[c] == pytest.approx(max(edges))


def test_silhouette_of_clear_groups(spark, cloud):
    points, labels = cloud
    v = vectors(spark, points, labels)
    row = cl.cluster_stats(si.tile_sums(v, ds.euclid), v).first()
    assert row["silhouette"] > 0.5 and row["clusters"] == 3 and row["noise"] == 0
    assert row["separation"] > row["average_within"]


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 30) if i != 14] + [(40, 41)], "id_a int, id_b int")
    ids = spark.range(45).selectExpr("CAST(id AS INT) AS id")
    out = {r["id"]: r["label"] for r in cl.connected(edges, ids).collect()}
    assert {out[i] for i in range(15)} == {0} and {out[i] for i in range(15, 31)} == {15}
    assert (out[41], out[44]) == (40, 44)


def test_agreement_with_itself(spark, cloud):
    points, labels = cloud
    v = vectors(spark, points, labels).select("id", "label")
    assert cl.agreement(v, v).first()[0] == 1.0


def test_sync_separates_opposite_trends(spark):
    rng = np.random.default_rng(11)
    t = np.arange(60)
    up = {i: 0.2 * t + rng.normal(size=60) for i in range(6)}
    odd = {6: -0.2 * t + rng.normal(size=60)}
    out = {r["id"]: r["label"] for r in cl.cluster_sync(panel(spark, {**up, **odd}), B=60).collect()}
    assert len({out[i] for i in range(6)}) == 1 and out[0] == 1
    assert out[6] == 0


def test_equal_processes_have_large_p(spark):
    rng = np.random.default_rng(4)

    def ar(phi):
        v = [0.0]
        for _ in range(199):
            v.append(phi * v[-1] + rng.normal())
        return v

    p = panel(spark, {0: ar(0.8), 1: ar(0.8), 2: ar(-0.8)}, "1950-01")
    arrays, kernel = si.feature_arrays(p, "ar", order=1)
    table = {(r["id_a"], r["id_b"]): r["dist"] for r in si.distance_table(arrays, kernel).collect()}
    assert table[0, 1] > 0.01 and table[0, 2] < 1e-6 and table[1, 2] < 1e-6


def test_spectral_distance_orders_processes(spark):
    t = np.arange(120)
    rng = np.random.default_rng(9)
    p = panel(spark, {0: np.sin(t) + rng.normal(scale=0.3, size=120), 1: np.sin(t + 1) + rng.normal(scale=0.3, size=120), 2: rng.normal(size=120).cumsum()})
    arrays, kernel = si.feature_arrays(p, "spectral")
    table = {(r["id_a"], r["id_b"]): r["dist"] for r in si.distance_table(arrays, kernel).collect()}
    assert table[0, 1] < table[0, 2] and table[0, 1] < table[1, 2] and min(table.values()) >= 0
