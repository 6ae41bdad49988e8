"""Clustering of series and statistics of a clustering."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import distances as ds
from seriesloom.operators.similarity import BLOCK, Chunk, chunk_numbers, chunk_pairs, chunks, per_row, shared_runs, tile_sums, tiles, z_arrays
from seriesloom.session import stage, unstage


def kmeans(arrays: DataFrame, k: int, seed: int = 1, max_iter: int = 20) -> DataFrame:
    """k-means on series vectors."""
    rows = stage(arrays.select("id", "a")).select("id", array_to_vector("a").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter).fit(rows)
    return model.transform(rows).select("id", (F.col("prediction") + 1).alias("label"))


def bisecting(arrays: DataFrame, k: int, seed: int = 1, max_iter: int = 20) -> DataFrame:
    """Hierarchical clusters cut at k, built from the top by splitting."""
    rows = stage(arrays.select("id", "a")).select("id", array_to_vector("a").alias("features"))
    model = BisectingKMeans(k=k, seed=seed, maxIter=max_iter).fit(rows)
    return model.transform(rows).select("id", (F.col("prediction") + 1).alias("label"))


def assign(arrays: DataFrame, medoids: Sequence[tuple], kernel: ds.Kernel) -> DataFrame:
    """Nearest medoid of every series. The k medoids travel with the task; no shuffle."""
    kind = arrays.schema["id"].dataType.simpleString()
    names = [m[0] for m in medoids]
    centres = np.array([m[1] for m in medoids], dtype=float)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            d = kernel(np.vstack(batch["a"].to_numpy()).astype(float), centres)
            best = d.argmin(axis=1)
            yield pd.DataFrame(
                {"id": batch["id"], "label": best + 1, "medoid": [names[i] for i in best], "dist": d[np.arange(len(d)), best]}
            )

    return arrays.select("id", "a").mapInPandas(nearest, f"id {kind}, label int, medoid {kind}, dist double")


def update(labelled: DataFrame, kernel: ds.Kernel, block: int = BLOCK) -> DataFrame:
    """The member of each cluster with the least summed distance to the others.

    ``labelled`` is (id, a, label). Sums come from tiles inside each cluster.
    """
    sums = tile_sums(labelled, kernel, block, within=True).select("id", "s")
    # a cluster of one has no pair and a sum of zero
    scored = labelled.join(sums, "id", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    return scored.groupBy("label").agg(F.min_by(F.struct("id", "a"), F.struct(F.round("s", 9), "id")).alias("_m")).select("label", "_m.*")


def spread_start(arrays: DataFrame, k: int, kernel: ds.Kernel, seed: int) -> list[tuple]:
    """k start medoids far from each other: each next one is drawn with weight distance squared.

    The draw is a seeded hash, so a rerun picks the same ones. One pass per medoid.
    """
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
    first = arrays.orderBy(F.xxhash64("id", F.lit(seed)), "id").first()
    found = [(first["id"], first["a"])]
    while len(found) < k:
        near = assign(arrays, found, kernel).where("dist > 0")
        pick = near.orderBy(-F.ln(u) / (F.col("dist") * F.col("dist")), "id").select("id").first()
        if pick is None:
            break
        row = arrays.where(F.col("id") == F.lit(pick["id"])).first()
        found.append((row["id"], row["a"]))
    return found


RINGS = 16


def with_medoids(arrays: DataFrame, medoids: Sequence[tuple], kernel: ds.Kernel, name: str = "d") -> DataFrame:
    """The rows with their distances to these series as an array. No shuffle."""
    centres = np.array([m[1] for m in medoids], dtype=float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(**{name: list(kernel(np.vstack(batch["a"].to_numpy()).astype(float), centres))})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in arrays.schema.fields)
    return arrays.mapInPandas(run, f"{schema}, {name} array<double>")


def _near(d: Column) -> list[Column]:
    """Place of the nearest medoid, the distance to it, and to the second nearest."""
    least = F.array_min(d)
    place = F.array_position(d, least).cast("int") - 1
    others = F.filter(d, lambda x, i: i != place)
    return [place.alias("m"), least.alias("d1"), F.coalesce(F.array_min(others), F.lit(float("inf"))).alias("d2")]


def best_swaps(seen: DataFrame, k: int, kernel: ds.Kernel, block: int = BLOCK, metric: bool = True, width: float | None = None) -> dict:
    """For each medoid, the series whose exchange with it lowers the summed distance most, among all series.

    ``seen`` is (id, a, d). A candidate x changes what a series o costs only where it is nearer to o than o's second medoid.
    Series are kept in rings around their medoid, finer near it than at ``width``; by the triangle inequality, a candidate's
    distance to that medoid rules out whole rings. Two chunks leave as one row per candidate and medoid, with what the exchange
    changes in all cases and what it changes beyond that if the ring's own medoid goes. Without ``metric`` no ring is ruled out.
    """
    kind = seen.schema["id"].dataType.simpleString()
    rows = seen.select("id", "a", "d", *_near(F.col("d")))
    width = width or float(rows.agg(F.max("d1")).first()[0] or 1.0)
    # half powers of two below the width; any division into rings is right, since their limits are measured
    ring = F.when(F.col("d1") > 0, F.greatest(F.lit(0), F.least(F.lit(RINGS - 1), F.lit(RINGS - 1) + F.ceil(2 * F.log2(F.col("d1") / width))))).otherwise(F.lit(0)).cast("int")
    rows = rows.withColumn("g", F.col("m") * RINGS + (ring if metric else F.lit(0)))
    stats = rows.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.max("d2").alias("far"), F.sum("d1").alias("cost"), F.sum(F.col("d2") - F.col("d1")).alias("loss"),
        F.array(*[F.min(F.col("d")[m]) for m in range(k)]).alias("from"), F.array(*[F.max(F.col("d")[m]) for m in range(k)]).alias("to"),
    ).orderBy("g").collect()  # at most k * RINGS rows
    group = np.array([r.g for r in stats])
    medoid, lo, hi, far = group // RINGS, *(np.array([r[c] for r in stats], float) for c in ("lo", "hi", "far"))
    # groups lie one after another; a group's rows are dealt by hash among the chunks it covers
    many = np.array([r.n for r in stats])
    before = np.cumsum(many) - many
    n, files = chunk_numbers(rows, block)
    size = max(1, -(-int(many.sum()) // n))
    cost = sum(r.cost for r in stats)
    loss = [sum(r.loss for r in stats if r.g // RINGS == m) for m in range(k)]
    # groups of candidates (rows) that can reach into groups of series (columns)
    least, most = (np.array([r[c] for r in stats], float)[:, medoid] for c in ("from", "to"))
    slack = 1e-9 * (1 + hi + np.where(np.isfinite(far), far, 0))
    reach = (least - hi < far + slack) & (lo - most < far + slack) if metric else np.ones((len(stats), len(stats)), bool)
    number = {int(g): i for i, g in enumerate(group)}

    @F.pandas_udf("int")
    def own_chunk(g: pd.Series, h: pd.Series) -> pd.Series:
        i = np.array([number[int(x)] for x in g], dtype=int)
        return pd.Series((before[i] + h.to_numpy() % many[i]) // size)

    # chunks one of which has a group that can reach into the other
    in_chunk = (before[:, None] < (np.arange(n) + 1) * size) & (before + many > (np.arange(n) * size)[:, None]).T
    wanted = in_chunk.T.astype(int) @ (reach | reach.T).astype(int) @ in_chunk.astype(int) > 0

    def reaching(to: np.ndarray, j: int) -> np.ndarray:
        """Which of these candidates, by their distances to a group's medoid, can reach into it."""
        to = to[:, medoid[j]]
        return (to - hi[j] < far[j] + slack[j]) & (lo[j] - to < far[j] + slack[j]) if metric else np.ones(len(to), bool)

    def gains(d: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """What candidates (rows) change at these series (columns): in all cases, and beyond that if the series' medoid goes; and the series."""
        every = np.minimum(d - d1, 0.0).sum(axis=1)
        # with one medoid there is no second; whatever goes, the candidate takes over
        own = np.minimum(d - d2, 0.0).sum(axis=1) if np.isfinite(d2).all() else (d - d1).sum(axis=1)
        if np.isnan(own).any():
            every = np.where(d < d1, d - d1, 0.0).sum(axis=1)
            own = np.where(d < d2, d - (d2 if np.isfinite(d2).all() else d1), 0.0).sum(axis=1)
        return np.vstack([every, own - every, np.full(len(d), d.shape[1])])

    def fold(left: Chunk, right: Chunk, same: bool) -> Iterator[pa.RecordBatch]:
        both = (left, right)
        to, d1, d2 = ([f(c) for c in both] for f in (lambda c: np.vstack(c.numpy("d")), lambda c: c.numpy("d1"), lambda c: c.numpy("d2")))
        groups = [[(number[int(g)], np.arange(a, b)) for a, b, g in zip(starts, np.append(starts[1:], len(c)), found)] for c in both for starts, found in [c.runs("g")]]
        # sums of the candidates of each side, by the medoid of the series they met
        held = [{int(medoid[j]): np.zeros((3, len(c))) for j, _ in met} for c, met in zip(both, groups[::-1])]
        if same:
            held[1] = held[0]

        def meet(side: int, own: np.ndarray, p: int, others: np.ndarray, q: int, back: bool = False) -> None:
            """Candidates of group p on this side at series of group q on the other; with ``back`` the latter as candidates, too."""
            for r in range(0, len(own), block):
                for c in range(0, len(others), block):
                    x, y = own[r : r + block], others[c : c + block]
                    d = kernel(both[side].a[x], both[1 - side].a[y])
                    held[side][int(medoid[q])][:, x] += gains(d, d1[1 - side][y], d2[1 - side][y])
                    if back:
                        held[1 - side][int(medoid[p])][:, y] += gains(d.T, d1[side][x], d2[side][x])

        for p, xs in groups[0]:
            for q, ys in groups[1]:
                if same and p >= q:
                    if p == q:
                        meet(0, xs[reaching(to[0][xs], q)], p, ys, q)
                    continue
                on_x, on_y = reaching(to[0][xs], q), reaching(to[1][ys], p)
                meet(0, xs[on_x], p, ys[on_y], q, back=True)
                meet(0, xs[on_x], p, ys[~on_y], q)
                meet(1, ys[on_y], q, xs[~on_x], p)
        for chunk, sums in list(zip((left, right), held))[: 1 if same else 2]:
            for m, (every, own, compared) in sums.items():
                at = np.nonzero(compared)[0]
                yield pa.record_batch(
                    {"id": chunk.arrow("id").take(pa.array(at)), "m": pa.array(np.full(len(at), m, np.int32)), "every": pa.array(every[at]), "own": pa.array(own[at]), "compared": pa.array(compared[at].astype(np.int64))}
                )

    placed = rows.withColumn("_h", F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
    packed = chunks(placed.select("id", "a", "d", "d1", "d2", "g", "_h"), n, files, ["g"], own_chunk("g", "_h"))
    tiles_ = chunk_pairs(packed, fold, f"id {kind}, m int, every double, own double, compared bigint", wanted)
    per = tiles_.groupBy("id", "m").agg(F.sum("every").alias("every"), F.sum("own").alias("own"), F.sum("compared").alias("compared"))
    per = per.groupBy("id").agg(F.sum("every").alias("every"), F.map_from_entries(F.collect_list(F.struct("m", "own"))).alias("own"), F.sum("compared").alias("compared"))
    losses = [x if np.isfinite(x) else 0.0 for x in loss]
    change = lambda m: F.round(F.lit(losses[m]) + F.coalesce(F.try_element_at("own", F.lit(m)), F.lit(0.0)) + F.col("every"), 9)
    best = per.agg(*[F.min(F.struct(change(m).alias("change"), "id")).alias(f"m{m}") for m in range(k)], F.sum("compared").alias("compared")).first()
    unstage(packed)
    return {"cost": cost, "swaps": sorted((best[m].change, best[m].id, m) for m in range(k)), "compared": best.compared}


def kmedoids(arrays: DataFrame, k: int, kernel: ds.Kernel, seed: int = 1, max_passes: int = 100, block: int = BLOCK, metric: bool = True) -> DataFrame:
    """Partition around k medoids: id, label, medoid, dist, converged.

    From medoids that lie far apart, a pass finds the best exchange for each medoid among all series and makes as many of
    them, the best one first, as lower the summed distance most together. It ends where no exchange of a medoid for any
    series lowers it; ``converged`` is false if ``max_passes`` came before that. Set ``metric`` to False for distances
    without the triangle inequality.
    """
    kept = stage(arrays.select("id", F.col("a").cast("array<double>").alias("a")))
    medoids = spread_start(kept, k, kernel, seed)
    k = len(medoids)
    state = stage(with_medoids(kept, medoids, kernel))
    seen, converged, width = state, False, None
    for _ in range(max_passes):
        width = width or float(seen.agg(F.max(F.array_min("d"))).first()[0] or 1.0)
        found = best_swaps(seen, k, kernel, block, metric, width)
        least = -1e-9 * max(1.0, abs(found["cost"]))
        swaps = [s for s in found["swaps"] if s[0] < least]
        if not swaps:
            converged = True
            break
        # at most k rows
        rows = {r["id"]: r["a"] for r in kept.where(F.col("id").isin([s[1] for s in swaps])).collect()}
        tried = stage(with_medoids(seen, [(i, rows[i]) for _, i, _ in swaps], kernel, "e"))
        places = [m for *_, m in swaps]
        after = lambda n: F.array(*[F.col("e")[places.index(m)] if m in places[:n] else F.col("d")[m] for m in range(k)])
        costs = tried.agg(*[F.sum(F.array_min(after(n))).alias(f"c{n}") for n in range(1, len(swaps) + 1)]).first()
        made = int(np.argmin(np.round(costs, 9))) + 1
        for _, i, m in swaps[:made]:
            medoids[m] = (i, rows[i])
        seen = tried.select("id", "a", after(made).alias("d"))
        unstage(state)
        state = tried
    labelled = seen.select("id", *_near(F.col("d")))
    names = F.array(*[F.lit(m[0]) for m in medoids])
    return labelled.select("id", (F.col("m") + 1).alias("label"), F.element_at(names, F.col("m") + 1).alias("medoid"), F.col("d1").alias("dist"), F.lit(converged).alias("converged"))


def cluster_info(labels: DataFrame) -> DataFrame:
    """Size and mean distance to the medoid per cluster."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.avg("dist").alias("av_dist"))


def connected(edges: DataFrame, ids: DataFrame, few: int = 200_000) -> DataFrame:
    """Smallest reachable id per id, by contracting stars.

    ``edges`` is (id_a, id_b), ``ids`` is (id). A round hangs each node's larger neighbours on the least of its neighbourhood,
    then its smaller ones; edges that say the same meet, and only they are joined. All ids come in once, at the end.
    """
    links = stage(edges.where("id_a <> id_b").select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v")).distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before, now = None, mark(links)
    while now != before and now[0] > few:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written before the join, so that both sides are shuffled and Spark can split a hot node
        low = stage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("low")))
        large = stage(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct())
        low = stage(large.groupBy("u").agg(F.min("v").alias("low")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.*")
        former, links = links, stage(small.where("u <> v").distinct())
        unstage(former)
        before, now = now, mark(links)
    kind = links.schema["u"].dataType.simpleString()

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict = {}

        def top(x):
            while (y := root.get(x, x)) != x:
                root[x] = x = root.get(y, y)
            return x

        for batch in batches:
            for u, v in zip(batch["u"].tolist(), batch["v"].tolist()):
                a, b = top(u), top(v)
                root[max(a, b)] = min(a, b)
        if root:
            yield pd.DataFrame({"id": list(root), "root": [top(x) for x in root]})

    roots = links.select(F.col("u").alias("id"), F.col("v").alias("root"))
    if now[0] <= few:
        roots = links.coalesce(1).mapInPandas(finish, f"id {kind}, root {kind}")
    return ids.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("label"))


def forest(arrays: DataFrame, kernel: ds.Kernel, keep: Callable[[np.ndarray], np.ndarray], block: int = BLOCK) -> DataFrame:
    """(id_a, id_b): links whose distance passes ``keep``, of each tile only a spanning forest.

    It connects what all links connect, and has at most one link less than the tile has series.
    """
    kind = arrays.schema["id"].dataType.simpleString()

    def emit(left: pd.DataFrame, right: pd.DataFrame, matrix: np.ndarray) -> pd.DataFrame:
        linked = ~np.isnan(matrix) & keep(matrix)
        names, n = np.concatenate([left["id"].to_numpy(), right["id"].to_numpy()]), len(left)
        if left["id"].equals(right["id"]):
            names, beside = names[:n], linked | linked.T
            around = lambda i: beside[i]
        else:
            around = lambda i: np.concatenate([np.zeros(n, bool), linked[i]]) if i < n else np.concatenate([linked[:, i - n], np.zeros(len(right), bool)])
        fresh, found = np.ones(len(names), bool), []
        for start in range(len(names)):
            walk = [start] if fresh[start] else []
            fresh[start] = False
            while walk:
                i = walk.pop()
                new = np.nonzero(around(i) & fresh)[0]
                fresh[new] = False
                found += [(i, j) for j in new]
                walk += new.tolist()
        a, b = (names[[e[s] for e in found]] if found else names[:0] for s in (0, 1))
        return pd.DataFrame({"id_a": np.where(a < b, a, b), "id_b": np.where(a < b, b, a)})

    return tiles(arrays, kernel, emit, f"id_a {kind}, id_b {kind}", block)


def cluster_pvalue(arrays: DataFrame, kernel: ds.Kernel, alpha: float, block: int = BLOCK) -> DataFrame:
    """Groups of series that are not significantly different: p-values above alpha link them. No pair leaves its tile
    that a spanning forest does not need."""
    return connected(forest(arrays, kernel, lambda p: p > alpha, block), arrays.select("id"))


def agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """Similarity of a partition to a true one (``left``), each (id, label): one row."""
    pairs = left.select("id", F.col("label").alias("g")).join(right.select("id", F.col("label").alias("a")), "id")
    both = pairs.groupBy("g", "a").agg(F.count(F.lit(1)).alias("n"))
    by_g = both.groupBy("g").agg(F.sum("n").alias("ng"))
    by_a = both.groupBy("a").agg(F.sum("n").alias("na"))
    score = 2 * F.col("n") / (F.col("ng") + F.col("na"))
    best = both.join(by_g, "g").join(by_a, "a").groupBy("g").agg(F.max(score).alias("best"))
    return best.agg(F.avg("best").alias("agreement"))


def cluster_stats(sums: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the usual quality measures of a clustering.

    ``sums`` comes from ``tile_sums``; ``labels`` is (id, label), where label 0 marks noise.
    """
    own = F.col("label") == F.col("other")
    each = sums.groupBy("id", "label").agg(
        F.sum(F.when(own, F.col("s"))).alias("s_in"),
        F.sum(F.when(own, F.col("n"))).alias("n_in"),
        F.sum(F.when(own, F.col("ss"))).alias("ss_in"),
        F.max(F.when(own, F.col("hi"))).alias("hi_in"),
        F.sum(F.when(~own, F.col("s"))).alias("s_out"),
        F.sum(F.when(~own, F.col("n"))).alias("n_out"),
        F.sum(F.when(~own, F.col("ss"))).alias("ss_out"),
        F.min(F.when(~own, F.col("lo"))).alias("lo_out"),
        F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"),
    )
    a = F.col("s_in") / F.col("n_in")
    wide = F.greatest(a, F.col("b"))
    each = each.withColumn("sil", F.when(F.col("n_in").isNull(), F.lit(0.0)).when(wide > 0, (F.col("b") - a) / wide))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    per = each.groupBy("label").agg(
        F.count(F.lit(1)).alias("size"),
        F.max("hi_in").alias("diameter"),
        F.min("lo_out").alias("separation"),
        F.sum("sil").alias("sil"),
        *[zero(c).alias(c) for c in ("s_in", "n_in", "ss_in", "s_out", "n_out", "ss_out")],
    )
    whole = per.agg(
        F.sum("size").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.max("diameter").alias("diameter"),
        F.min("separation").alias("separation"),
        (F.sum("sil") / F.sum("size")).alias("silhouette"),
        # every pair was seen from both ends
        *[(F.sum(c) / 2).alias(c) for c in ("s_in", "n_in", "ss_in", "s_out", "n_out", "ss_out")],
        F.sum(F.col("ss_in") / 2 / F.col("size")).alias("w"),
    )
    pairs = F.col("n_in") + F.col("n_out")
    s, ss = F.col("s_in") + F.col("s_out"), F.col("ss_in") + F.col("ss_out")
    total = ss / F.col("n")
    cov = F.col("s_out") / pairs - s / pairs * F.col("n_out") / pairs
    share = F.col("n_out") / pairs
    scale = F.sqrt((ss / pairs - F.pow(s / pairs, F.lit(2.0))) * share * (1 - share))
    noise = labels.where(F.col("label") == 0).agg(F.count(F.lit(1))).scalar()
    return whole.select(
        "n",
        F.col("k").alias("clusters"),
        noise.alias("noise"),
        "diameter",
        "separation",
        (F.col("s_in") / F.col("n_in")).alias("average_within"),
        (F.col("s_out") / F.col("n_out")).alias("average_between"),
        "silhouette",
        (((total - F.col("w")) / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("ch"),
        (cov / F.nullif(scale, F.lit(0.0))).alias("pearson_gamma"),
    )


def cluster_profile(sums: DataFrame) -> DataFrame:
    """Diameter, separation and mean distances per cluster."""
    own = F.col("label") == F.col("other")
    return sums.groupBy("label").agg(
        F.count_distinct("id").alias("size"),
        F.max(F.when(own, F.col("hi"))).alias("diameter"),
        F.min(F.when(~own, F.col("lo"))).alias("separation"),
        (F.sum(F.when(own, F.col("s"))) / F.sum(F.when(own, F.col("n")))).alias("average_distance"),
        (F.sum(F.when(~own, F.col("s"))) / F.sum(F.when(~own, F.col("n")))).alias("average_toother"),
    )


def widest_gap(labelled: DataFrame, kernel: ds.Kernel, block: int = BLOCK) -> DataFrame:
    """Largest edge of each cluster's minimum spanning tree.

    Rounds: every component takes its cheapest edge to another component of its cluster, and
    linked components merge. Two chunks leave as one row per component, its cheapest such edge. Chunks are sorted by
    component, and blocks of a single one are passed over, so that rounds get cheaper as components grow.
    """
    kind = labelled.schema["id"].dataType.simpleString()
    schema = f"comp {kind}, other {kind}, label int, dist double"
    base = stage(labelled.select("id", "a", F.col("label").cast("int").alias("label")))

    def numbered(left: Chunk, right: Chunk, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """The components of two chunks as numbers in their order."""
        x, y = left.numpy("comp"), right.numpy("comp")
        if same:
            x = y = np.unique(x, return_inverse=True)[1]
            return x, y
        both = np.unique(np.concatenate([x, y]), return_inverse=True)[1]
        return both[: len(x)], both[len(x) :]

    def fold(left: Chunk, right: Chunk, same: bool) -> Iterator[pa.RecordBatch]:
        of_x, of_y = numbered(left, right, same)
        for label, xs, ys in shared_runs(left, right, left.runs("label"), right.runs("label")):
            x, y, mine, others = left.a[xs], right.a[ys], of_x[xs], of_y[ys]
            near = [(np.full(len(v), np.inf), np.zeros(len(v), int)) for v in (x, y)]
            if same:
                near[1] = near[0]

            def shorten(side: int, at: slice, dist: np.ndarray, places: Callable[[np.ndarray], np.ndarray]) -> None:
                least, where = (v[at] for v in near[side])
                better = np.nonzero(dist < least)[0]
                if len(better):
                    least[better], where[better] = dist[better], places(better)

            for r in range(0, len(x), block):
                for c in range(r if same else 0, len(y), block):
                    rows, cols = slice(r, r + block), slice(c, c + block)
                    a, b = mine[rows], others[cols]
                    # sorted, so the ends tell whether there is one component only
                    if a[0] == a[-1] == b[0] == b[-1]:
                        continue
                    d = kernel(x[rows], y[cols])
                    if not np.isfinite(d.max()):
                        d = np.nan_to_num(d, nan=np.inf)
                    d[a[:, None] == b[None, :]] = np.inf
                    shorten(0, rows, d.min(axis=1), lambda i: c + d[i].argmin(axis=1))
                    if not (same and r == c):
                        shorten(1, cols, d.min(axis=0), lambda j: r + d[:, j].argmin(axis=0))
            for here, there, numbers, own, far, (dist, where) in ((left, right, mine, xs, ys, near[0]), (right, left, others, ys, xs, near[1]))[: 1 if same else 2]:
                order = np.lexsort((dist, numbers))
                order = order[np.isfinite(dist[order])]
                best = order[np.concatenate([[True], numbers[order][1:] != numbers[order][:-1]])[: len(order)]]
                yield pa.record_batch(
                    {
                        "comp": here.arrow("comp").take(pa.array(own.start + best)),
                        "other": there.arrow("comp").take(pa.array(far.start + where[best])),
                        "label": pa.array(np.full(len(best), label, np.int32)),
                        "dist": pa.array(dist[best]),
                    }
                )

    numbers = chunk_numbers(base, block)
    comps = stage(base.where(F.col("id").isNotNull()).select("id", F.col("id").alias("comp")).distinct())
    tree = None
    while True:
        packed = chunks(base.join(comps, "id"), *numbers, ["label", "comp"])
        # equal distances need no order: an edge that closes a ring of them is as long as the others
        best = chunk_pairs(packed, fold, schema).groupBy("comp", "label").agg(F.min_by(F.struct("other", "dist"), F.struct("dist", "other")).alias("_e"))
        best = stage(best.select("comp", "label", "_e.*"))
        unstage(packed)
        if best.isEmpty():
            break
        step = best.groupBy("label").agg(F.max("dist").alias("gap"))
        tree = step if tree is None else tree.unionByName(step)
        roots = connected(best.select(F.col("comp").alias("id_a"), F.col("other").alias("id_b")), comps.select(F.col("comp").alias("id")).distinct())
        comps = stage(comps.join(roots.select(F.col("id").alias("comp"), F.col("label").alias("_root")), "comp").select("id", F.col("_root").alias("comp")))
    sizes = base.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    if tree is None:
        return sizes.select("label", F.lit(0.0).alias("widest_gap"))
    return sizes.join(tree.groupBy("label").agg(F.max("gap").alias("widest_gap")), "label", "left").select("label", F.coalesce("widest_gap", F.lit(0.0)).alias("widest_gap"))


def cluster_sync(panel: DataFrame, window: int = 3, B: int = 100, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """Groups of series that share a linear trend; label 0 marks series that share it with no other.

    A test of a group: residuals from the group's trend are prewhitened, and the sum of their
    window statistics is compared with B draws of noise. A series is one row with its B draws,
    so a test is one pass with a small aggregate. While the test rejects, the series that
    contributes most leaves; those that left form the pool of the next group. Series leave one
    by one, so the number of tests grows with the series that do not fit.
    """
    remaining = stage(z_arrays(panel))
    labelled, label = None, 1
    while True:
        left: list = []
        while True:
            group = remaining.where(~F.col("id").isin(left)) if left else remaining
            p, size, worst = sync_test(group, window, B, seed)
            if size <= 1 or p >= alpha:
                break
            left.append(worst)
        part = group.select("id", F.lit(label if size > 1 else 0).alias("label"))
        labelled = part if labelled is None else labelled.unionByName(part)
        if not left:
            return labelled
        label += int(size > 1)
        remaining = stage(remaining.where(F.col("id").isin(left)))


def sync_test(group: DataFrame, window: int, B: int, seed: int) -> tuple[float, int, object]:
    """p-value of a common linear trend, the number of series, and the series that contributes most."""
    trend = group.select(F.posexplode("a").alias("t", "v")).agg(F.regr_slope("v", "t").alias("b"), F.regr_intercept("v", "t").alias("c")).first()
    slope, level = float(trend["b"] or 0.0), float(trend["c"] or 0.0)

    def statistics(v: np.ndarray) -> np.ndarray:
        e = v - level - slope * np.arange(len(v))
        e = e - e.mean()
        phi = ds.difference_ar1(e)
        white = e[1:] - phi * e[:-1]
        # in units of its own noise, so that no series outweighs the others by its scale
        white = white / (white.std() or 1.0)
        # draws are seeded by the series' values, so a rerun of the task repeats them
        rng = np.random.default_rng([seed, *np.abs(v[:4] * 1e6).astype(np.int64).tolist()])
        noise = rng.normal(size=(B, len(white)))
        return ds.window_statistic(np.vstack([white[None, :], noise]), window)

    stats = stage(group.select("id", F.posexplode(per_row(statistics, "a")).alias("draw", "stat")))
    draws = stats.groupBy("draw").agg(F.sum("stat").alias("total"), F.count(F.lit(1)).alias("n"))
    observed = draws.where("draw = 0").first()
    p = draws.where("draw > 0").agg(F.avg((F.abs("total") >= abs(observed["total"])).cast("int"))).first()[0]
    worst = stats.where("draw = 0").orderBy(F.desc(F.abs("stat")), "id").first()["id"]
    return float(p), int(observed["n"]), worst
