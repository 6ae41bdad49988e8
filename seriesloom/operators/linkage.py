"""Ward clusters of many series, by a summary tree of bounded size.

Ward's rule needs a cluster's count and sum only, so a group of close series can stand in for them. Each task
reduces its rows to at most ``leaves`` such groups by Ward's own merges, a few tasks' groups meet and are reduced again, level by level, and
the merges of the last level are the top of the tree. The work is linear in the series: no distance between two series of
different tasks is computed, and the driver holds at most ``leaves`` sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.session import stage, unstage

LEAF = "n double, s array<double>, ss double"


def merge_down(n: np.ndarray, s: np.ndarray, keep: int) -> tuple[np.ndarray, list[float]]:
    """Merge the cheapest pair until ``keep`` groups are left: the group of each input, and the costs of the merges.

    A merge costs the rise of the sum of squares around the centres. Each group remembers its cheapest
    partner, so a merge looks at one row of costs and at the groups whose partner changed.
    """
    n, s = n.astype(float).copy(), s.astype(float).copy()
    m = len(n)
    owner, live, heights = np.arange(m), np.ones(m, bool), []
    if m <= keep:
        return owner, heights
    centres = s / n[:, None]
    square = (centres**2).sum(axis=1)
    cost = np.maximum(square[:, None] + square[None, :] - 2 * centres @ centres.T, 0) * (n[:, None] * n[None, :] / (n[:, None] + n[None, :]))
    np.fill_diagonal(cost, np.inf)
    near = cost.argmin(axis=1)
    least = cost[np.arange(m), near]
    for _ in range(m - keep):
        a = int(least.argmin())
        a, b = sorted((a, int(near[a])))
        heights.append(float(cost[a, b]))
        owner[owner == b] = a
        n[a], s[a] = n[a] + n[b], s[a] + s[b]
        centres[a] = s[a] / n[a]
        live[b] = False
        cost[b, :] = cost[:, b] = least[b] = np.inf
        row = ((centres - centres[a]) ** 2).sum(axis=1) * (n * n[a] / (n + n[a]))
        row[~live] = row[a] = np.inf
        cost[a, :] = cost[:, a] = row
        closer = row < least
        near[closer], least[closer] = a, row[closer]
        stale = np.flatnonzero(live & ~closer & ((near == a) | (near == b)))
        stale = np.union1d(stale, [a])
        near[stale] = cost[stale].argmin(axis=1)
        least[stale] = cost[stale, near[stale]]
    return owner, heights


def _leaves(batches: Iterator[pd.DataFrame], leaves: int) -> Iterator[pd.DataFrame]:
    """The groups of one task: rows come in slices, and groups are merged whenever there are twice too many."""
    n, s, ss = np.zeros(0), None, np.zeros(0)
    for batch in batches:
        for k in range(0, len(batch), leaves):
            part = batch.iloc[k : k + leaves]
            sums = np.vstack(part["s"].to_numpy()).astype(float)
            n, ss = np.append(n, part["n"].to_numpy()), np.append(ss, part["ss"].to_numpy())
            s = sums if s is None else np.vstack([s, sums])
            owner, _ = merge_down(n, s, leaves)
            kept, group = np.unique(owner, return_inverse=True)
            fold = np.zeros((len(kept), len(owner)))
            fold[group, np.arange(len(owner))] = 1.0
            n, s, ss = fold @ n, fold @ s, fold @ ss
    if s is not None:
        yield pd.DataFrame({"n": n, "s": list(s), "ss": ss})


def _whole(a: str) -> Column:
    return F.coalesce(F.forall(a, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))), F.lit(False))


def summary_tree(arrays: DataFrame, leaves: int = 256, fan: int = 16) -> DataFrame:
    """n, s and ss (count, sum of vectors, sum of squared lengths) of at most ``leaves`` groups of all whole series."""
    squares = F.aggregate("a", F.lit(0.0), lambda t, v: t + v * v)
    rows = arrays.where(_whole("a")).select(F.lit(1.0).alias("n"), F.col("a").cast("array<double>").alias("s"), squares.alias("ss"))
    reduced = lambda df: stage(df.mapInPandas(lambda batches: _leaves(batches, leaves), LEAF))
    parts, level = rows.rdd.getNumPartitions(), reduced(rows)
    while parts > 1:
        parts, former = -(-parts // fan), level
        # in a fixed order, so that a task that runs again gives the same groups
        level = reduced(former.repartition(parts, "n", "ss").sortWithinPartitions("n", "ss", "s"))
        unstage(former)
    return level


def _top(tree: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Counts, sums and groups of the leaves, and the costs of the merges down to ``k`` groups."""
    rows = tree.orderBy("n", "ss", "s").collect()
    n, s = np.array([r.n for r in rows]), np.array([r.s for r in rows])
    owner, heights = merge_down(n, s, k) if rows else (np.zeros(0, int), [])
    return n, s, owner, heights


def ward(arrays: DataFrame, k: int, leaves: int = 256, fan: int = 16) -> DataFrame:
    """id and label (1 to k, the largest cluster first) by Ward's rule.

    A series gets the cluster of the leaf with the nearest centre. The labels are those of exact Ward merges where
    clusters lie further apart than leaves are wide; with no more series than ``leaves`` in one task they always are. Series that are null or
    hold null or non-finite values have a null label; fewer different series than k give fewer clusters.
    """
    if k > leaves:
        raise ValueError("k is larger than the number of leaves")
    kind = arrays.schema["id"].dataType.simpleString()
    rows = arrays.select("id", "a")
    n, s, owner, _ = _top(summary_tree(rows, leaves, fan), k)
    groups = sorted(set(owner.tolist()), key=lambda g: (-n[owner == g].sum(), (s[owner == g].sum(axis=0) / n[owner == g].sum()).tolist()))
    label = np.array([groups.index(g) + 1 for g in owner.tolist()], int)
    centres = s / n[:, None] if len(n) else s

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.vstack(batch["a"].to_numpy()).astype(float)
                far = (centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T
                yield pd.DataFrame({"id": batch["id"], "label": label[far.argmin(axis=1)]})

    found = rows.where(_whole("a")).mapInPandas(nearest, f"id {kind}, label int")
    return found.unionAll(rows.where(~_whole("a")).select("id", F.lit(None).cast("int").alias("label")))


def ward_heights(arrays: DataFrame, most: int = 20, leaves: int = 256, fan: int = 16) -> DataFrame:
    """clusters, height: what the merge that leaves so many clusters adds to the sum of squares within clusters, for the last ``most`` merges."""
    _, _, _, heights = _top(summary_tree(arrays.select("id", "a"), leaves, fan), 1)
    last = [(i + 1, h) for i, h in enumerate(heights[::-1][:most])]
    return arrays.sparkSession.createDataFrame(last, "clusters int, height double")
