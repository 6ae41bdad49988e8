"""Product codes of vectors: exact rounds of k-means over integer parts, by metric trees.

Rows are gathered into chunks of bounded size. In a chunk, each part position gets an anchors hierarchy: about the square
root of the points become anchors, each the farthest point of the widest anchor so far, and take over the points nearer to
them; balls are merged from the anchors upwards by the smallest joint ball, and each anchor's points are split downwards in
the same way. A ball keeps its sum, count and radius. The trees are written once and read in every round.

A round walks each tree from the root with a list of entries that may own points of a ball. An entry leaves the list when
the bisector between it and the entry nearest to the centre does not cut the ball; children inherit what is left. A ball
with one entry left is counted by its sum and count, unseen; at the leaves, exact integer distances decide. Sums by part and
entry leave a task as at most ``256 * dimensions`` rows and are added up by Spark.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import slim, stage

PARTS, SCALE = 4, 1024
#: points of a leaf (but for equal points, and below so many splits), rows of a chunk and numbers of a chunk, at most
LEAF, DEPTH, CHUNK, CHUNK_VALUES = 24, 8, 4096, 1 << 19
#: integers below this give products and sums of floats without rounding, up to 2,000 components a part
SAFE = 1 << 20


# --- trees


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances of floats, never below zero."""
    found = (points * points).sum(1)[:, None] - 2 * (points @ others.T) + (others * others).sum(1)[None, :]
    return np.maximum(found, 0.0)


def anchors(points: np.ndarray) -> np.ndarray:
    """The anchor's number of each point, for about the square root of their count anchors."""
    many = max(2, math.isqrt(len(points)))
    owner = np.zeros(len(points), np.int32)
    own = np.sqrt(((points - points[0]) ** 2).sum(1))
    chosen = points[:1]
    for k in range(1, many):
        far = int(own.argmax())  # in the widest ball, its farthest point
        if own[far] == 0:
            break
        gap = np.sqrt(((chosen - points[far]) ** 2).sum(1))
        # a point nearer to its anchor than half the way to the new one stays
        maybe = np.nonzero(own >= gap[owner] / 2)[0]
        new = np.sqrt(((points[maybe] - points[far]) ** 2).sum(1))
        taken = new < own[maybe]
        owner[maybe[taken]], own[maybe[taken]] = k, new[taken]
        owner[far], own[far] = k, 0.0
        chosen = np.vstack([chosen, points[far]])
    return owner


class Tree:
    """Balls over ``points``: rows ``order[start:stop]``, sum, count and radius around the mean; children or -1."""

    def __init__(self, points: np.ndarray, exact: np.ndarray):
        self.floats, self.exact = points, exact
        self.order: list[np.ndarray] = []
        self.rows: list[tuple] = []
        self._at, self._depth = 0, 0
        self.root = self._split(np.arange(len(points)))
        order = np.concatenate(self.order)
        start, stop, left, right = (np.array([r[i] for r in self.rows], np.int32) for i in range(4))
        self.state = (exact[order], order.astype(np.int32), start, stop, left, right, np.array([r[4] for r in self.rows]), np.array([r[5] for r in self.rows], dtype=exact.dtype if exact.dtype == object else np.int64), self.root)

    def _node(self, ids: np.ndarray, start: int, left: int, right: int) -> int:
        total = self.exact[ids].sum(0)
        centre = total.astype(float) / len(ids)
        radius = math.sqrt(((self.floats[ids] - centre) ** 2).sum(1).max())
        self.rows.append((start, start + len(ids), left, right, radius, total))
        return len(self.rows) - 1

    def _split(self, ids: np.ndarray) -> int:
        """The node of these points, with all below it."""
        owner = anchors(self.floats[ids]) if len(ids) > LEAF and self._depth < DEPTH else None
        if owner is None or owner.max() == 0:
            self.order.append(ids)
            self._at += len(ids)
            return self._node(ids, self._at - len(ids), -1, -1)
        self._depth += 1
        node = self._merge([ids[owner == k] for k in range(owner.max() + 1)])
        self._depth -= 1
        return node

    def _merge(self, groups: list[np.ndarray]) -> int:
        """Join the two balls of the smallest joint ball until one is left, then lay out the points from there."""
        groups = [g for g in groups if len(g)]
        k = len(groups)
        centre = np.array([self.floats[g].mean(0) for g in groups])
        count = np.array([float(len(g)) for g in groups])
        radius = np.array([math.sqrt(((self.floats[g] - c) ** 2).sum(1).max()) for g, c in zip(groups, centre)])
        gap = np.sqrt(distances(centre, centre))
        joint = np.maximum((gap + radius[:, None] + radius[None, :]) / 2, np.maximum(radius[:, None], radius[None, :]))
        np.fill_diagonal(joint, np.inf)
        shape: list = list(range(k))
        for _ in range(k - 1):
            i, j = divmod(int(joint.argmin()), k)
            i, j = min(i, j), max(i, j)
            shape[i], shape[j] = (shape[i], shape[j]), None
            centre[i] = (centre[i] * count[i] + centre[j] * count[j]) / (count[i] + count[j])
            radius[i], count[i] = joint[i, j], count[i] + count[j]
            gone = np.isinf(joint[i])
            to = np.sqrt(((centre - centre[i]) ** 2).sum(1))
            new = np.maximum((to + radius + radius[i]) / 2, np.maximum(radius, radius[i]))
            new[gone] = np.inf
            new[[i, j]] = np.inf
            joint[i], joint[:, i] = new, new
            joint[j], joint[:, j] = np.inf, np.inf
        return self._lay(shape[0], groups)[0]

    def _lay(self, shape, groups: list[np.ndarray]) -> tuple[int, np.ndarray]:
        if not isinstance(shape, tuple):
            return self._split(groups[shape]), groups[shape]
        start = self._at
        (left, a), (right, b) = self._lay(shape[0], groups), self._lay(shape[1], groups)
        ids = np.concatenate([a, b])
        return self._node(ids, start, left, right), ids


def walk(state: tuple, book: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[int, int, np.ndarray]]]:
    """Balls wholly owned, as (nodes, entries) pairs, and leaves as (start, stop, entry of each point)."""
    points, _, start, stop, left, right, radius, sums, root = state
    centre = sums.astype(float) / (stop - start)[:, None]
    entries = book.astype(float)
    gaps = np.sqrt(distances(entries, entries))
    scale = max(np.abs(entries).max(initial=0.0), np.abs(centre).max(initial=0.0) + radius.max(initial=0.0))
    plain = points.dtype != object and book.dtype != object
    squares = (entries * entries).sum(1)
    owned, leaves = [], []
    nodes, alive = np.array([root]), np.ones((1, len(book)), bool)
    while len(nodes):
        away = np.where(alive, distances(centre[nodes], entries), np.inf)
        best = away.argmin(1)
        reach = 2 * radius[nodes, None] * gaps[best]
        least = away[np.arange(len(nodes)), best][:, None]
        # the slack is far above the rounding of floats, so no entry that may own a point leaves
        alive &= ~(away - least - reach > 1e-9 * (away + reach) + 1e-12 * scale * scale)
        alive[np.arange(len(nodes)), best] = True
        single = alive.sum(1) == 1
        if single.any():
            owned.append((nodes[single], best[single]))
        ends = ~single & (left[nodes] < 0)
        for at in np.nonzero(ends)[0]:
            a, b = start[nodes[at]], stop[nodes[at]]
            listed = np.nonzero(alive[at])[0]
            if plain:
                far = squares[listed] - 2 * (points[a:b].astype(float) @ entries[listed].T)
            else:
                far = ((points[a:b, None, :].astype(object) - book[listed][None].astype(object)) ** 2).sum(2)
            leaves.append((a, b, listed[far.argmin(1)]))
        more = ~single & ~ends
        nodes, alive = np.concatenate([left[nodes[more]], right[nodes[more]]]), np.concatenate([alive[more], alive[more]])
    return owned, leaves


# --- chunks


def integers(values: np.ndarray) -> np.ndarray:
    """floor(1024 x), as small integers or, where one is large, as Python's."""
    scaled = np.floor(values * SCALE)
    most = np.abs(scaled).max(initial=0.0)
    if most < SAFE:
        return scaled.astype(np.int16 if most < 1 << 15 else np.int32)
    found = np.empty(values.shape, object)
    found.flat = [math.floor(v * SCALE) if abs(v) < 2.0**900 else int(v) * SCALE for v in values.ravel().tolist()]
    return found


def plant(dims: int, vec_id: pa.DataType, label: pa.DataType):
    """Chunks of rows with a tree for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, min(CHUNK, CHUNK_VALUES // dims))
        held, rows = [], 0

        def chunk(table: pa.Table) -> pa.RecordBatch:
            values = table.column("v").combine_chunks()
            whole = integers(values.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, dims))
            trees = []
            for p in np.split(whole, PARTS, axis=1):
                trees.append(pickle.dumps(Tree(p.astype(float), p).state, protocol=5))
            as_list = lambda name, kind: pa.array([table.column(name).to_pylist()], pa.list_(kind))
            return pa.RecordBatch.from_arrays(
                [as_list("vec_id", vec_id), as_list("label", label), pa.array([trees], pa.list_(pa.binary()))], ["ids", "labels", "trees"]
            )

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= most:
                whole = pa.Table.from_batches(held)
                yield chunk(whole.slice(0, most))
                held, rows = whole.slice(most).to_batches(), rows - most
        if rows:
            yield chunk(pa.Table.from_batches(held))

    return run


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, list[bytes]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("ids")[i].values, batch.column("labels")[i].values, [x.as_py() for x in batch.column("trees")[i].values]


LIMB = 1 << 60
SUMS = "part int, entry int, at int, n long, hi decimal(38,0), lo decimal(38,0)"


def gather(books: list[np.ndarray]):
    """Sums and counts of the parts by entry, over all chunks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(b.shape, np.int64) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for _, _, trees in one_by_one(batches):
            for p, (tree, book) in enumerate(zip(trees, books)):
                state = pickle.loads(tree)
                points, start, stop, sums = state[0], state[2], state[3], state[7]
                if points.dtype == object:
                    total[p] = total[p].astype(object)
                owned, leaves = walk(state, book)
                for nodes, entry in owned:
                    np.add.at(total[p], entry, sums[nodes])
                    np.add.at(count[p], entry, (stop - start)[nodes])
                if leaves:
                    entry = np.concatenate([e for _, _, e in leaves])
                    np.add.at(total[p], entry, np.concatenate([points[a:b] for a, b, _ in leaves]))
                    np.add.at(count[p], entry, 1)
        rows = [
            (p, e, i, int(count[p][e]), Decimal(int(v) // LIMB), Decimal(int(v) % LIMB))
            for p in range(len(books))
            for e in np.nonzero(count[p])[0].tolist()
            for i, v in enumerate(total[p][e].tolist())
        ]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0)]
        if rows:
            names = [c.split(" ")[0] for c in SUMS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def encode(books: list[np.ndarray]):
    """Each row's code and the sum of its squared distances (null beyond a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, trees in one_by_one(batches):
            code, error = np.zeros((len(ids), PARTS), np.uint8), 0
            for p, (tree, book) in enumerate(zip(trees, books)):
                state = pickle.loads(tree)
                points, order, start, stop = state[:4]
                entry = np.zeros(len(ids), np.int64)
                owned, leaves = walk(state, book)
                for nodes, entries in owned:
                    for k, e in zip(nodes, entries):
                        entry[start[k] : stop[k]] = e
                for a, b, e in leaves:
                    entry[a:b] = e
                wide = points.dtype == object or book.dtype == object
                far = ((points.astype(object if wide else np.int64) - book[entry].astype(object if wide else np.int64)) ** 2).sum(1)
                back = np.empty(len(ids), far.dtype)
                back[order], code[order, p] = far, entry
                error = error + back
            text = code.tobytes().hex()
            codes = pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string())
            errors = pa.array([int(e) if e < 1 << 63 else None for e in error.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, labels, codes, errors], ["vec_id", "label", "code", "error"])

    return run


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def as_book(rows: list[list[int]]) -> np.ndarray:
    found = np.array(rows, object)
    return found.astype(np.int64) if max((abs(v) for v in found.ravel().tolist()), default=0) < SAFE else found


def usable(vector: Column) -> Column:
    """A vector with components that are all numbers and finite."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))


def product_codes(vectors: DataFrame, entries: int = 256, rounds: int = 4, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row for each row with a usable vector.

    Rows whose vector is null or empty, or has a null or non-finite component, are left out, and so are vectors that are not
    as long as that of the smallest id; that length has to be a multiple of 4. The first codebooks are the parts of the
    ``entries`` (at most 256) smallest ids, null ids last, equal ids in the order of their vectors; with fewer rows, there
    are fewer entries. Repeated ids and rows count each time. An error beyond a long is null. An empty table gives no row.
    Other columns are neither read nor kept, so their names cannot clash.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries has to be between 1 and 256")
    own = slim(vectors, vec_id=vec_id, v=embedding, label=label)
    own = own.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"), "label").where(usable(F.col("v")))
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = own.orderBy(*order).limit(1).select(F.size("v")).first()
    kind = own.schema["label"].dataType.simpleString()
    if first is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    dims = first[0]
    if dims % PARTS:
        raise ValueError(f"vectors of {dims} components cannot be cut into {PARTS} equal parts")
    own = own.where(F.size("v") == dims)
    # at most 256 rows
    start = integers(np.array([r.v for r in own.orderBy(*order).limit(entries).select("v").collect()], float))
    books = [as_book(p.tolist()) for p in np.split(start, PARTS, axis=1)]
    arrow = _arrow_of(own)
    trees = stage(own.mapInArrow(plant(dims, arrow["vec_id"], arrow["label"]), f"ids array<bigint>, labels array<{kind}>, trees array<binary>"))
    for _ in range(rounds):
        sums = trees.mapInArrow(gather(books), SUMS).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("hi").alias("hi"), F.sum("lo").alias("lo"))
        lists = [b.tolist() for b in books]
        for r in sums.collect():  # at most entries * dims rows
            lists[r.part][r.entry][r.at] = (int(r.hi) * LIMB + int(r.lo)) // r.n
        books = [as_book(x) for x in lists]
    codes = stage(trees.mapInArrow(encode(books), f"vec_id long, label {kind}, code string, error long"))
    # written before the join, so that both sides are shuffled and Spark can split a hot label
    by_label = stage(codes.groupBy("label").agg(F.try_sum("error").alias("label_error"))).withColumnRenamed("label", "_label")
    joined = codes.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _arrow_of(df: DataFrame) -> dict[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return {f.name: to_arrow_type(f.dataType) for f in df.schema.fields}
