"""Distances between series.

A distance is a feature array per series, computed row by row, and a kernel that compares two
blocks of features. Series fall into hash blocks of bounded size; one task compares one pair of
blocks (a tile), so no task sees more than two blocks and no series array is copied per pair.
``distance_table`` lists the whole matrix, which is quadratic by definition and meant for up to
some ten thousand series. ``within`` and ``nearest`` leave only links, ``tile_sums`` one row per series
and cluster.

Where a task can sum up what it compares, it takes two chunks of many blocks (``chunks``, ``chunk_pairs``). Chunks are
written once and read by the tasks that need them, so disk does not grow with the number of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions import distances as ds
from seriesloom.functions.warping import Counter, Warping
from seriesloom.operators.diagnostics import lag_products
from seriesloom.session import stage

BLOCK = 256
# bytes of series in a chunk, and chunks in a file
CHUNK, PER_FILE = 1 << 23, 4


def z_arrays(panel: DataFrame, key: str = "id", when: str = "ds", value: str = "y") -> DataFrame:
    """One row per series with its z-scored values in date order; series without variation are left out.

    The moments come from the same aggregate as the array. Computed from the array inside the
    row, the optimizer would move them into the lambda and repeat them per element.
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.col(when).alias("t"), F.col(value).alias("v"))))
    nested = panel.groupBy(key).agg(pairs.alias("_p"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = F.transform("_p", lambda p: (p["v"] - F.col("_m")) / F.col("_s"))
    return nested.where(F.col("_s") > 0).select(F.col(key).alias("id"), z.alias("a"))


def per_row(fn: Callable[[np.ndarray], np.ndarray], column: str | Column) -> Column:
    """Apply a small array helper to each row of a batch."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: fn(np.asarray(v, dtype=float)))

    return run(column)


def feature_arrays(panel: DataFrame, how: str, p: float = 0.05, max_lag: int = 25, points: int = 100, order: int | None = None) -> tuple[DataFrame, ds.Kernel]:
    """Per-series features of a distance and its kernel, written once since tiles read them twice.

    ``panel`` is (id, ds, y) on a full calendar.
    """
    features, kernel = _features(panel, how, p, max_lag, points, order)
    return stage(features), kernel


def _features(panel: DataFrame, how: str, p: float, max_lag: int, points: int, order: int | None) -> tuple[DataFrame, ds.Kernel]:
    if how == "acf":
        sums = lag_products(panel, ["id"], "y", range(1, max_lag + 1)).where(F.col("_ss") > 0)
        weight = lambda k: F.sqrt(F.lit(p) * F.pow(F.lit(1 - p), k + 1))
        return sums.select("id", F.transform("_lp", lambda s, k: s / F.col("_ss") * weight(k)).alias("a")), ds.euclid
    z = z_arrays(panel)
    if how == "euclid":
        return z, ds.euclid
    if how == "intper":
        return z.withColumn("a", per_row(ds.integrated_periodogram, "a")), ds.manhattan
    if how == "spectral":
        return z.withColumn("a", per_row(lambda v: ds.log_spectrum(v, points), "a")), ds.likelihood_ratio
    if how == "ar":
        if order is None:
            best = z.select(per_row(lambda v: np.array([ds.ar_order(v, min(6, len(v) // 6 or 1))]), "a")[0].alias("k"))
            order = int(best.agg(F.max("k")).first()[0])
        k = order
        return z.withColumn("a", per_row(lambda v: ds.ar_features(v, k), "a")), ds.ar_wald(k)
    raise ValueError(f"unknown distance {how}")


def dtw_arrays(panel: DataFrame, window: int | None = None, diagonal: float = 2.0) -> tuple[DataFrame, ds.Kernel]:
    return stage(z_arrays(panel)), ds.dtw(window, diagonal)


# tiles


def _blocks(arrays: DataFrame, block: int) -> int:
    return max(1, math.ceil(arrays.count() / block))


def paired_blocks(rows: DataFrame, compare: Callable, schema: str, block: int = BLOCK, within: str | None = None, own: bool | None = None) -> DataFrame:
    """Bring each pair of hash blocks together: ``compare(left, right, same)`` gives the rows of a tile.

    With ``within`` only rows that share that column meet. ``own`` keeps to the tiles of a block with itself (True) or
    to the others (False).
    """
    n = _blocks(rows, block)
    placed = rows.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    more = [within] if within else []
    if own:
        return placed.groupBy("_b", *more).applyInPandas(lambda mine: compare(mine, mine, True), schema)
    keys = ["_i", "_j", *more]
    # F.sequence counts down where the end is below the start
    if own is None:
        ahead, back = F.sequence(F.col("_b"), F.lit(n - 1)), F.sequence(F.lit(0), F.col("_b"))
    else:
        ahead = F.when(F.col("_b") < n - 1, F.sequence(F.col("_b") + 1, F.lit(n - 1)))
        back = F.when(F.col("_b") > 0, F.sequence(F.lit(0), F.col("_b") - 1))
    left = placed.select("*", F.col("_b").alias("_i"), F.explode(ahead).alias("_j"))
    # fresh names, since both sides come from the same frame
    again = placed.select(*[F.col(c).alias(c) for c in placed.columns])
    right = again.select("*", F.explode(back).alias("_i"), F.col("_b").alias("_j"))
    empty = pd.DataFrame(columns=[c.strip().split(" ")[0] for c in schema.split(",")])

    def run(left_rows: pd.DataFrame, right_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(left_rows) or not len(right_rows):
            return empty
        return compare(left_rows, right_rows, left_rows["_i"].iat[0] == left_rows["_j"].iat[0])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def matrix_of(rows: pd.DataFrame) -> np.ndarray:
    return np.vstack(rows["a"].to_numpy()).astype(float)


def once(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> np.ndarray:
    """The pairs of a tile that count: in a block with itself, those with the left id before the right one."""
    if not same:
        return np.ones((len(left), len(right)), bool)
    return left["id"].to_numpy()[:, None] < right["id"].to_numpy()[None, :]


def tiles(arrays: DataFrame, kernel: ds.Kernel, emit: Callable, schema: str, block: int = BLOCK, within: str | None = None) -> DataFrame:
    """Compare all pairs of blocks. ``emit(left, right, matrix)`` turns a tile into rows.

    ``matrix`` has NaN where a pair must not count (a series with itself, or a pair that
    another tile or position covers). With ``within`` only pairs that share that column meet.
    """

    def compare(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        matrix = kernel(matrix_of(left), matrix_of(right))
        matrix[~once(left, right, same)] = np.nan
        return emit(left, right, matrix)

    return paired_blocks(arrays, compare, schema, block, within)


def pairs_schema(arrays: DataFrame) -> str:
    kind = arrays.schema["id"].dataType.simpleString()
    return f"id_a {kind}, id_b {kind}, dist double"


def pair_rows(left: pd.DataFrame, right: pd.DataFrame, i: np.ndarray, j: np.ndarray, dist: np.ndarray) -> pd.DataFrame:
    a, b = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
    return pd.DataFrame({"id_a": np.where(a < b, a, b), "id_b": np.where(a < b, b, a), "dist": dist})


def links(arrays: DataFrame, kernel: ds.Kernel, keep: Callable[[np.ndarray], np.ndarray], block: int = BLOCK) -> DataFrame:
    """(id_a, id_b, dist) of the pairs whose distance passes ``keep``; the others never leave their tile."""

    def emit(left: pd.DataFrame, right: pd.DataFrame, matrix: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero(~np.isnan(matrix) & keep(matrix))
        return pair_rows(left, right, i, j, matrix[i, j])

    return tiles(arrays, kernel, emit, pairs_schema(arrays), block)


def within(arrays: DataFrame, metric: ds.Kernel | Warping, eps: float, block: int = BLOCK) -> DataFrame:
    """The pairs at a distance of at most ``eps``: (id_a, id_b, dist) with ``id_a < id_b``."""
    if not isinstance(metric, Warping):
        return links(arrays, metric, lambda m: m <= eps, block)

    def compare(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        return pair_rows(left, right, *metric.within(matrix_of(left), matrix_of(right), once(left, right, same), eps))

    return paired_blocks(arrays, compare, pairs_schema(arrays), block)


def nearest(arrays: DataFrame, metric: ds.Kernel | Warping, k: int, block: int = BLOCK) -> DataFrame:
    """The k nearest others of each series: (id, rank, other, dist); equal distances in the order of the ids.

    A block with itself gives each series a first limit, which is written; the other tiles start from it. A tile leaves as
    at most about ``2 k`` rows per series (more on equal distances).
    """
    kept = stage(arrays.select("id", "a"))
    kind = kept.schema["id"].dataType.simpleString()
    schema = f"id {kind}, other {kind}, dist double"

    def compare(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        allowed, x, y = once(left, right, same), matrix_of(left), matrix_of(right)
        limits = [f["limit"].to_numpy(float) if "limit" in f else np.full(len(f), np.inf) for f in (left, right)]
        if same:
            # one set of rows on both sides: each pair in both directions
            allowed = allowed | allowed.T
        if isinstance(metric, Warping):
            i, j, d = metric.nearest(x, y, allowed, k, *limits)
        else:
            matrix = np.where(allowed, metric(x, y), np.inf)
            near = lambda axis: np.sort(matrix, axis=axis).take(min(k, matrix.shape[axis]) - 1, axis=axis)
            i, j = np.nonzero(allowed & ((matrix <= np.minimum(limits[0], near(1))[:, None]) | (matrix <= np.minimum(limits[1], near(0))[None, :])))
            d = matrix[i, j]
        a, b = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        if same:
            return pd.DataFrame({"id": a, "other": b, "dist": d})
        return pd.DataFrame({"id": np.concatenate([a, b]), "other": np.concatenate([b, a]), "dist": np.concatenate([d, d])})

    place = F.row_number().over(Window.partitionBy("id").orderBy("dist", "other"))
    ranked = lambda rows: rows.withColumn("rank", place).where(F.col("rank") <= k)
    first = stage(ranked(paired_blocks(kept, compare, schema, block, own=True)))
    limits = first.groupBy("id").agg(F.when(F.count(F.lit(1)) == k, F.max("dist")).alias("limit"))
    limited = stage(kept.join(limits, "id", "left").withColumn("limit", F.coalesce("limit", F.lit(math.inf))))
    rest = paired_blocks(limited, compare, schema, block, own=False)
    return ranked(first.select("id", "other", "dist").unionByName(rest)).select("id", "rank", "other", "dist")


def search_counts(arrays: DataFrame, metric: Warping, eps: float, block: int = BLOCK) -> DataFrame:
    """One row: pairs of a search for distances of at most ``eps``, those the bound leaves, and those compared to the end."""

    def compare(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        own = replace(metric, counter=Counter())
        own.within(matrix_of(left), matrix_of(right), once(left, right, same), eps)
        return pd.DataFrame([vars(own.counter)])

    counts = paired_blocks(arrays, compare, "pairs bigint, bounded bigint, finished bigint", block)
    return counts.agg(*[F.sum(c).alias(c) for c in counts.columns])


def distance_table(arrays: DataFrame, kernel: ds.Kernel, block: int = BLOCK) -> DataFrame:
    """The whole matrix as rows ``(id_a, id_b, dist)`` with ``id_a < id_b``."""
    return links(arrays, kernel, lambda m: np.ones(m.shape, bool), block)


# chunks


class Chunk:
    """The rows of a chunk: ``a`` as a matrix, the other columns by name, as Arrow or numpy arrays."""

    def __init__(self, body: pa.Buffer):
        self.table = pa.ipc.open_stream(body).read_all().combine_chunks()
        series = self.table["a"].combine_chunks() if self.table["a"].num_chunks != 1 else self.table["a"].chunk(0)
        width = pc.unique(pc.list_value_length(series)).to_pylist()
        if len(width) != 1 or width[0] is None:
            raise ValueError(f"series of lengths {width} cannot be compared")
        self.a = series.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width[0])

    def __len__(self) -> int:
        return len(self.a)

    def arrow(self, name: str) -> pa.Array:
        column = self.table[name]
        return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()

    def numpy(self, name: str) -> np.ndarray:
        return self.arrow(name).to_numpy(zero_copy_only=False)

    def runs(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """First rows and values of the runs of an int column that the chunk is sorted by; NO stands for NULL."""
        values = pc.fill_null(self.arrow(name).cast(pa.int64()), NO).to_numpy(zero_copy_only=False)
        starts = np.nonzero(np.concatenate([[True], values[1:] != values[:-1]]))[0]
        return starts, values[starts]


NO = np.iinfo(np.int64).min


def chunk_numbers(rows: DataFrame, block: int) -> tuple[int, int]:
    """Numbers of chunks and files. A chunk has CHUNK bytes of series at most, a file PER_FILE chunks; few rows are
    divided further, down to a block, until there are some pairs of files for each core."""
    count, width = rows.agg(F.count(F.lit(1)), F.max(F.size("a"))).first()
    spread = math.ceil(math.sqrt(16 * rows.sparkSession.sparkContext.defaultParallelism))
    n = max(1, math.ceil(count * 8 * (width or 0) / CHUNK), min(spread, math.ceil(count / block)))
    return n, min(n, max(spread, math.ceil(n / PER_FILE)))


def chunks(rows: DataFrame, n: int, files: int, order: Sequence[str], place: Column | None = None) -> DataFrame:
    """Rows as n chunks, written once: (chunk, body), a body being the chunk's rows as an Arrow stream, sorted by ``order``.

    ``place`` numbers a row's chunk; without it rows fall into chunks by their id's hash. Neighbouring chunks share a file.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(n)) if place is None else place
    columns = rows.columns
    placed = rows.withColumn("_b", place.cast("int")).withColumn("_f", F.floor(F.col("_b") * F.lit(files) / F.lit(n)).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        for number in pc.unique(whole["_b"]).to_pylist():
            mine = whole.filter(pc.equal(whole["_b"], number)).select(columns)
            mine = mine.take(pc.sort_indices(mine.select(list(order)), sort_keys=[(c, "ascending") for c in order])).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, mine.schema) as out:
                out.write_table(mine)
            yield pa.record_batch({"chunk": pa.array([number], pa.int32()), "body": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return stage(placed.repartitionByRange(files, "_f").mapInArrow(pack, "chunk int, body binary"))


def chunk_pairs(packed: DataFrame, fold: Callable, schema: str, wanted: np.ndarray | None = None) -> DataFrame:
    """What ``fold(left, right, same)`` yields for each two chunks, the left one not after the right one.

    A task reads the chunks of two files, without a shuffle. ``wanted`` marks the pairs that count, by chunk numbers.
    """
    left = packed.select(F.col("chunk").alias("_i"), F.col("body").alias("_x"))
    right = packed.select(F.col("chunk").alias("_j"), F.col("body").alias("_y"))
    met = F.col("_i") <= F.col("_j")
    if wanted is not None and not wanted.all():
        marks = "".join("01"[int(w)] for w in wanted.ravel())
        met &= F.substr(F.lit(marks), F.col("_i") * F.lit(wanted.shape[1]) + F.col("_j") + 1, F.lit(1)) == "1"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x, y in zip(*(batch.column(c) for c in ("_i", "_j", "_x", "_y"))):
                same = i.as_py() == j.as_py()
                one = Chunk(x.as_buffer())
                yield from fold(one, one if same else Chunk(y.as_buffer()), same)

    return left.hint("shuffle_replicate_nl").join(right, met).mapInArrow(run, schema)


def _run_sums(matrix: np.ndarray, starts: np.ndarray, axis: int) -> list[np.ndarray]:
    """Number, sum, sum of squares, least and largest value of each run of columns (axis 1) or rows (axis 0); NaN does not count."""

    def reduced(ufunc: np.ufunc, m: np.ndarray) -> np.ndarray:
        return ufunc.reduce(m, axis=axis, keepdims=True) if len(starts) == 1 else ufunc.reduceat(m, starts, axis=axis)

    s = reduced(np.add, matrix)
    if np.isnan(s).any():
        seen = ~np.isnan(matrix)
        zero = np.where(seen, matrix, 0.0)
        out = [reduced(np.add, seen.astype(float)), reduced(np.add, zero), reduced(np.add, zero * zero)]
        out += [reduced(np.minimum, np.where(seen, matrix, np.inf)), reduced(np.maximum, np.where(seen, matrix, -np.inf))]
    else:
        sizes = np.diff(np.append(starts, matrix.shape[axis])).astype(float)
        n = np.broadcast_to(sizes[None, :] if axis else sizes[:, None], s.shape)
        out = [n, s, reduced(np.add, matrix * matrix), reduced(np.minimum, matrix), reduced(np.maximum, matrix)]
    return out if axis else [o.T for o in out]


# numbers in the sums that a task holds
HELD = 1 << 22


def tile_sums(labelled: DataFrame, kernel: ds.Kernel, block: int = BLOCK, within: bool = False) -> DataFrame:
    """Per series and cluster: number, sum, sum of squares, least and largest distance to its members.

    ``labelled`` is (id, a, label). Two chunks leave as at most one row per series and cluster, so
    the pairs themselves are never rows. ``within`` keeps to the series' own cluster.
    """
    kind = labelled.schema["id"].dataType.simpleString()
    schema = f"id {kind}, label int, other int, n bigint, s double, ss double, lo double, hi double"

    def fresh(rows: int, runs: int) -> list[np.ndarray]:
        return [np.full((rows, runs), v) for v in (0.0, 0.0, 0.0, np.inf, -np.inf)]

    def gather(held: list[np.ndarray], rows: slice, runs: slice, more: list[np.ndarray]) -> None:
        for ufunc, to, new in zip((np.add, np.add, np.add, np.minimum, np.maximum), held, more):
            ufunc(to[rows, runs], new, out=to[rows, runs])

    def rows_of(chunk: Chunk, first: int, others: np.ndarray, held: list[np.ndarray]) -> pa.RecordBatch:
        i, c = np.nonzero((held[0] > 0) & (others != NO))
        at = pa.array(first + i)
        n, *values = (h[i, c] for h in held)
        return pa.record_batch(
            {"id": chunk.arrow("id").take(at), "label": chunk.arrow("label").take(at), "other": pa.array(others[c].astype(np.int32)), "n": pa.array(n.astype(np.int64))}
            | {name: pa.array(v) for name, v in zip(("s", "ss", "lo", "hi"), values)}
        )

    def covered(starts: np.ndarray, lo: int, hi: int) -> tuple[slice, np.ndarray]:
        """The runs that reach into rows lo to hi, and where they start there."""
        runs = slice(np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi, "left"))
        return runs, np.maximum(starts[runs] - lo, 0)

    def compared(left: Chunk, right: Chunk, same: bool, xs: slice, ys: slice, of_x: tuple, of_y: tuple) -> Iterator[pa.RecordBatch]:
        (starts_x, labels_x), (starts_y, labels_y) = of_x, of_y
        x, y = left.a[xs], right.a[ys]
        ids = left.numpy("id")[xs] if same else None
        # all of the sums at once, or those of fewer rows where there are many labels
        step = len(x) if len(y) * len(labels_x) + len(x) * len(labels_y) <= HELD else max(1, HELD // (len(y) + len(labels_y)))
        step = -(-step // block) * block if same else step
        for top in range(0, len(x), step):
            end = min(top + step, len(x))
            inside, _ = covered(starts_x, top, end)
            of_left, of_right = fresh(end - top, len(labels_y)), fresh(len(y), inside.stop - inside.start)
            for r in range(top, end, block):
                r_end = min(r + block, end)
                rows, at_rows = covered(starts_x, r, r_end)
                # a chunk with itself: from the diagonal on
                for c in range(r if same else 0, len(y), block):
                    c_end = min(c + block, len(y))
                    matrix = kernel(x[r:r_end], y[c:c_end])
                    if same:
                        own = ids[r:r_end, None] == ids[None, c:c_end]
                        if own.any():
                            matrix[own] = np.nan
                    cols, at_cols = covered(starts_y, c, c_end)
                    gather(of_left, slice(r - top, r_end - top), cols, _run_sums(matrix, at_cols, 1))
                    if not (same and r == c):
                        gather(of_right, slice(c, c_end), slice(rows.start - inside.start, rows.stop - inside.start), _run_sums(matrix, at_rows, 0))
            yield rows_of(left, xs.start + top, labels_y, of_left)
            yield rows_of(right, ys.start, labels_x[inside], of_right)

    def fold(left: Chunk, right: Chunk, same: bool) -> Iterator[pa.RecordBatch]:
        of_x, of_y = left.runs("label"), right.runs("label")
        if not within:
            yield from compared(left, right, same, slice(0, len(left)), slice(0, len(right)), of_x, of_y)
            return
        for label, xs, ys in shared_runs(left, right, of_x, of_y):
            alone = np.zeros(1, int), np.array([label])
            yield from compared(left, right, same, xs, ys, alone, alone)

    rows = labelled.select("id", "a", F.col("label").cast("int").alias("label")).where(F.col("id").isNotNull())
    parts = chunk_pairs(chunks(rows, *chunk_numbers(rows, block), ["label"]), fold, schema)
    return parts.groupBy("id", "label", "other").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )


def shared_runs(left: Chunk, right: Chunk, of_left: tuple, of_right: tuple) -> Iterator[tuple[int, slice, slice]]:
    """The values, but for NULL, that two chunks share, with the rows of each."""
    (starts_x, values_x), (starts_y, values_y) = of_left, of_right
    ends_x, ends_y = np.append(starts_x[1:], len(left)), np.append(starts_y[1:], len(right))
    for value, i, j in zip(*np.intersect1d(values_x, values_y, assume_unique=True, return_indices=True)):
        if value != NO:
            yield int(value), slice(int(starts_x[i]), int(ends_x[i])), slice(int(starts_y[j]), int(ends_y[j]))
