"""Sums, gaps and exchanges over chunks: what they write to disk, and odd rows."""

import numpy as np
import pytest

from seriesloom.functions import distances as ds
from seriesloom.operators import clustering as cl
from seriesloom.operators import similarity as si

ROWS = "id int, a array<double>, label int"


@pytest.fixture(scope="module")
def many():
    rng = np.random.default_rng(8)
    return rng.normal(size=(400, 64)), rng.integers(1, 4, size=400)


def frame(spark, points, labels):
    return spark.createDataFrame([(i, [float(v) for v in p], int(c)) for i, (p, c) in enumerate(zip(points, labels))], ROWS)


def shuffled(spark, run):
    """MB of shuffle files that a run leaves."""

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        out = {}
        while found.hasNext():
            file = found.next()
            out[file.getName()] = file.length()
        return out

    before = files()
    run()
    return sum(size for name, size in files().items() if name not in before and name.startswith("shuffle_")) / 1e6


def test_exchanges_are_found_without_a_copy_of_the_rows_per_block(spark, many):
    """Of forty blocks; the rows are 0.2 MB."""
    points, _ = many
    v = frame(spark, points, np.ones(400))
    seen = cl.stage(cl.with_medoids(v.select("id", "a"), [(i, points[i]) for i in range(3)], ds.euclid))
    assert shuffled(spark, lambda: cl.best_swaps(seen, 3, ds.euclid, block=10, metric=False)) < 3


def test_exchanges_equal_brute_force(spark, many):
    points, _ = many
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    medoids = [3, 50, 370]
    cost = lambda of: d[:, of].min(axis=1).sum()
    for k in (1, 3):
        seen = cl.stage(cl.with_medoids(frame(spark, points, np.ones(400)).select("id", "a"), [(i, points[i]) for i in medoids[:k]], ds.euclid))
        found = cl.best_swaps(seen, k, ds.euclid, block=64)
        assert found["cost"] == pytest.approx(cost(medoids[:k]))
        for change, i, m in found["swaps"]:
            after = [cost([*medoids[:m], x, *medoids[m + 1 : k]]) for x in range(400)]
            assert i == int(np.argmin(after)) and change == pytest.approx(min(after) - cost(medoids[:k]), abs=1e-6)


def test_gaps_pass_over_blocks_of_one_component(spark):
    """Each point is nearest to the one before it, so that the first round links all; the last one compared all pairs again."""
    points = np.cumsum(1.2 ** np.arange(64))[:, None]
    compared = spark.sparkContext.accumulator(0)

    def kernel(x, y):
        compared.add(len(x) * len(y))
        return ds.euclid(x, y)

    assert [tuple(r) for r in cl.widest_gap(frame(spark, points, np.ones(64)), kernel, block=8).collect()] == [(1, pytest.approx(1.2**63))]
    assert 64 * 63 / 2 <= compared.value < 1.5 * 64 * 63 / 2


@pytest.mark.parametrize("within", [False, True])
def test_sums_do_not_write_the_rows_per_block(spark, many, within):
    points, labels = many
    v = cl.stage(frame(spark, points, labels))
    assert shuffled(spark, lambda: si.tile_sums(v, ds.euclid, 10, within).collect()) < 3


@pytest.mark.parametrize("how", ["stats", "profile", "update"])
def test_measures_do_not_write_the_rows_per_block(spark, many, how):
    points, labels = many
    v = cl.stage(frame(spark, points, labels))
    runs = {
        "stats": lambda: cl.cluster_stats(si.tile_sums(v, ds.euclid, 10), v).collect(),
        "profile": lambda: cl.cluster_profile(si.tile_sums(v, ds.euclid, 10)).collect(),
        "update": lambda: cl.update(v, ds.euclid, 10).collect(),
    }
    assert shuffled(spark, runs[how]) < 3


@pytest.mark.parametrize("block,held", [(5, 1 << 22), (16, 200), (256, 1 << 22)])
@pytest.mark.parametrize("within", [False, True])
def test_sums_of_odd_rows(spark, monkeypatch, block, held, within):
    """Ids that come twice, alike and not; labels that are missing; a series with NaN; many labels."""
    monkeypatch.setattr(si, "HELD", held)
    rng = np.random.default_rng(1)
    ids = [*range(60), *range(0, 20), 7]
    points = rng.normal(size=(81, 4))
    points[60:70] = points[:10]
    points[33, 2] = np.nan
    labels = [*rng.integers(0, 25, size=60).tolist(), *[None] * 5, *rng.integers(0, 25, size=16).tolist()]
    v = spark.createDataFrame([(i, p.tolist(), c) for i, p, c in zip(ids, points, labels)], ROWS)
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    want = {}
    for x in range(81):
        for y in range(81):
            if ids[x] != ids[y] and labels[y] is not None and not np.isnan(d[x, y]) and (not within or labels[x] == labels[y]):
                want.setdefault((ids[x], labels[x], labels[y]), []).append(d[x, y])
    got = {(r["id"], r["label"], r["other"]): r for r in si.tile_sums(v, ds.euclid, block, within).collect()}
    assert set(got) == set(want)
    for key, r in got.items():
        w = np.array(want[key])
        assert (r["n"], r["s"], r["ss"], r["lo"], r["hi"]) == (len(w), *(pytest.approx(x, abs=1e-9) for x in (w.sum(), (w * w).sum(), w.min(), w.max())))


def test_text_ids_and_empty_tables(spark):
    rows = [("b", [0.0, 0.0], 1), ("a", [3.0, 4.0], 1), ("c", [0.0, 1.0], 2), ("d", [0.0, 8.0], 1)]
    v = spark.createDataFrame(rows, "id string, a array<double>, label int")
    assert {(r["id"], r["other"]): r["s"] for r in si.tile_sums(v, ds.euclid, 2).collect() if r["other"] == 2} == pytest.approx({("b", 2): 1.0, ("a", 2): 18**0.5, ("d", 2): 7.0})
    assert {r["label"]: r["widest_gap"] for r in cl.widest_gap(v, ds.euclid, 2).collect()} == {1: pytest.approx(5.0), 2: 0.0}
    assert si.tile_sums(v.limit(0), ds.euclid).count() == 0 and cl.widest_gap(v.limit(0), ds.euclid).count() == 0


def test_distances_that_cancel():
    """Points far from the origin and equal ones, for which the product of the squares has no digits left."""
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(30, 5)), 1e6 + rng.normal(size=(30, 5)), np.zeros((1, 5)), [[np.inf, 0, 0, 0, 0]]])
    with np.errstate(invalid="ignore"):
        want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        got = ds.euclid(x, x)
    assert np.allclose(got, want, rtol=1e-10, atol=0, equal_nan=True) and (np.diag(got)[:-1] == 0).all()
    assert ds.euclid(x[:0], x).shape == (0, 62) and ds.euclid(x, x[:0]).shape == (62, 0)
