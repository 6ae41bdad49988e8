"""Ward's rule on the summary tree against exact merges."""

import numpy as np
import pytest

from seriesloom.operators import linkage


def exact_ward(points, k):
    """Merges by trial of all pairs, from the definition."""
    groups = [[i] for i in range(len(points))]
    heights = []

    def rise(a, b):
        spread = lambda g: ((points[g] - points[g].mean(axis=0)) ** 2).sum()
        return spread(a + b) - spread(a) - spread(b)

    while len(groups) > k:
        h, i, j = min((rise(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups[i + 1 :], i + 1))
        heights.append(h)
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}, heights


def frame(spark, points, parts=1):
    rows = [(i, [None if v is None else float(v) for v in p] if p is not None else None) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id long, a array<double>").repartition(parts, "id")


def clusters(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.label, set()).add(r.id)
    return {frozenset(g) for g in out.values()}


def test_merges_are_exact():
    rng = np.random.default_rng(1)
    for _ in range(8):
        points = rng.normal(size=(24, 3))
        owner, heights = linkage.merge_down(np.ones(24), points, 4)
        want, rises = exact_ward(points, 4)
        assert {frozenset(np.flatnonzero(owner == g).tolist()) for g in set(owner.tolist())} == want
        assert np.allclose(heights, rises)


@pytest.mark.parametrize("parts, leaves, fan", [(1, 256, 16), (7, 12, 2), (40, 8, 3)])
def test_same_cut_on_separated_data(spark, parts, leaves, fan):
    rng = np.random.default_rng(2)
    points = np.vstack([rng.normal(c, 0.5, size=(20, 4)) for c in (0, 9, 20, 40)])
    want, _ = exact_ward(points, 4)
    assert clusters(linkage.ward(frame(spark, points, parts), 4, leaves, fan)) == want


def test_tree_is_bounded_and_loses_nothing(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(3000, 5))
    leaves = linkage.summary_tree(frame(spark, points, 9), leaves=30, fan=3).collect()
    assert len(leaves) <= 30 and sum(r.n for r in leaves) == 3000
    assert np.allclose(np.sum([r.s for r in leaves], axis=0), points.sum(axis=0))
    assert np.isclose(sum(r.ss for r in leaves), (points**2).sum())


def test_heights(spark):
    points = np.random.default_rng(4).normal(size=(30, 3))
    got = [r.height for r in linkage.ward_heights(frame(spark, points), most=5).orderBy("clusters").collect()]
    assert np.allclose(got, exact_ward(points, 1)[1][::-1][:5])


def test_odd_input(spark):
    points = [[0.0, 0.0], [0.0, 0.0], None, [9.0, 9.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [9.0, 9.0], [0.0, 0.0]]
    got = {r.id: r.label for r in linkage.ward(frame(spark, points, 3), 2).collect()}
    assert got == {0: 1, 1: 1, 8: 1, 3: 2, 7: 2, 2: None, 4: None, 5: None, 6: None}
    assert linkage.ward(frame(spark, points, 3).where("id < 0"), 2).count() == 0
    with pytest.raises(ValueError):
        linkage.ward(frame(spark, points), 9, leaves=4)
