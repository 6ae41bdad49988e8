"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find.

Signatures. Each element draws a random permutation of the slots and ranks them; the value it offers to the slot at rank j lies
in [j, j+1), and a slot keeps its least value. Ranks are worked through in order over all elements of a document at
once and stop as soon as every slot has a value below the next rank, so long documents need very few of them.

Links. Documents with equal shingle sets become one representative first. A representative meets others where a
band of its signature is equal. In a few rounds each is compared with one partner of its buckets, another in each round, which
joins most of a group of copies without listing its pairs; a round is left out when the tiles have little left to compare, or when
the round before hardly lessened it. What still lies in one bucket but in different components is compared
in tiles of bounded size by whole signatures. Rows that have a partner which may be similar enough get their full sets, and
their tile confirms the pairs and joins components as it goes, most similar pairs first: only links leave it, no pairs. Every link
is confirmed on the full sets of both texts.

``BANDS`` x ``ROWS`` slots miss a pair at the threshold of 0.8 with a probability of (1 - 0.8 ** 5) ** 40 = 1.3e-7; the
filter in the tiles, four and a half standard errors below the threshold, with 3e-6 at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from seriesloom.llm.components import components
from seriesloom.llm.tables import batches_of, slim, sorted_runs, stage
from seriesloom.session import unstage

BANDS, ROWS = 40, 5
SLOTS = BANDS * ROWS
TILE = 512
# comparisons for each row of a bucket that the tiles may have left
PAIRS = 64

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words(dict):
    """64-bit hashes of words, remembered up to a number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, size: int, known: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words; of the whole sequence if it has fewer words.

    Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return,
    with A-Z lower-cased. No text and no words give an empty set.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = np.zeros(max(1, len(h) - size + 1), np.uint64)
    for k in range(min(size, len(h))):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[k : k + len(out)] + _U(k + 1))
    return np.unique(out if len(h) >= size else mix(out + _U(len(h) * 0xD6E8FEB86659FD93 % 2**64)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash of each set, one row of ``SLOTS`` values; rows of empty sets are all ones."""
    out = np.full((len(sets), SLOTS), ~_U(0))
    for a, b in _runs([len(s) for s in sets], 60_000):
        _signatures(sets[a:b], out[a:b])
    return out


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _signatures(sets: list[np.ndarray], out: np.ndarray) -> None:
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(owner):
        return
    element = np.concatenate(sets)
    slots = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(element), 1))
    flat, row = out.ravel(), np.arange(len(element))
    for j in range(SLOTS):
        draw = mix(element + _U((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        # a slot among those not yet ranked, and the value: rank in the upper bits, random below
        k = j + ((draw >> _U(32)) * _U(SLOTS - j) >> _U(32)).astype(np.int64)
        chosen = slots[row, k]
        slots[row, k] = slots[row, j]
        value = (_U(j) << _U(48)) | (mix(draw) >> _U(16))
        np.minimum.at(flat, owner * SLOTS + chosen, value)
        # a document is done when its largest value has a rank of j or less: later ranks cannot get below it
        done = (out.max(axis=1) >> _U(48)) <= j
        if done.all():
            return
        if j % 4 == 3:
            live = ~done[owner]
            owner, element, slots = owner[live], element[live], slots[live]
            row = np.arange(len(element))


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different for equal values in different bands."""
    key = np.zeros((len(signature), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    parts = signature.reshape(len(signature), BANDS, ROWS)
    for r in range(ROWS):
        key = mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def _sign(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, same (128-bit key of the set), bands and short signature (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches_of(batches, "text"):
            sets = [shingle_set(t, size, known) for t in batch.column("text").to_pylist()]
            signed = signatures(sets)
            keys = band_keys(signed)
            full = [len(s) > 0 for s in sets]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "same": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if f else None for s, f in zip(sets, full)], pa.binary()),
                    "bands": pa.array([k.tobytes() if f else None for k, f in zip(keys, full)], pa.binary()),
                    "short": pa.array([v.tobytes() if f else None for v, f in zip(mix(signed).astype(np.uint16), full)], pa.binary()),
                }
            )

    return docs.mapInArrow(run, "doc_id long, n long, same binary, bands binary, short binary")


def _unfold(reps: DataFrame) -> DataFrame:
    """key, id, look: one row for each band of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
                ids, looks = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), BANDS) for c in ("id", "look"))
                for a in range(0, len(ids), 200_000):
                    yield pa.record_batch({"key": pa.array(keys[a : a + 200_000]), "id": pa.array(ids[a : a + 200_000]), "look": pa.array(looks[a : a + 200_000])})

    return reps.select("id", "look", "bands").mapInArrow(run, "key long, id long, look int")


def alike(p: np.ndarray, q: np.ndarray, share: int) -> bool:
    """100 * intersection >= share * union of two sorted sets."""
    if 100 * min(len(p), len(q)) < share * max(len(p), len(q)):
        return False
    both = np.sort(np.concatenate([p, q]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= share * (len(p) + len(q) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The rows of ``pairs`` (``a``, ``b`` and others) and whether the full sets (``id``, ``items``) of a and b are alike."""
    names, schema = pairs.columns, StructType([*pairs.schema.fields, StructField("ok", BooleanType())])
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), share) for x, y in zip(batch.column("x"), batch.column("y"))]
            yield pa.record_batch({c: batch.column(c) for c in names} | {"ok": pa.array(keep, pa.bool_())})

    return met.select(*names, "x", "y").mapInArrow(run, schema)


def _blocks(members: DataFrame, order: Column) -> DataFrame:
    """A row for each bucket (``key``) of several components.

    main: its largest component; mains, others: the blocks of main and of the rest; n_all and pairs: its rows and how many pairs
    of them the tiles compare; partner: the component and id of its smallest row by ``order``.
    """
    counts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n_own"), F.min(order).alias("rank"), F.min_by("id", order).alias("id"))
    buckets = counts.groupBy("key").agg(
        F.max(F.struct("n_own", "component")).alias("top"), F.sum("n_own").alias("n_all"), F.count(F.lit(1)).alias("n_comp"), F.min(F.struct("rank", "component", "id")).alias("partner")
    )
    rest = F.col("n_all") - F.col("top.n_own")
    return buckets.where("n_comp > 1").select(
        "key",
        F.col("top.component").alias("main"),
        F.ceil(rest / TILE).cast("int").alias("others"),
        F.ceil(F.col("top.n_own") / TILE).cast("int").alias("mains"),
        "n_all",
        (rest * F.col("n_all")).alias("pairs"),
        F.struct("partner.component", "partner.id").alias("partner"),
    )


def _tile_links(members: DataFrame, blocks: DataFrame, looks: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links between different components that share a bucket: enough of them to join all that are linked.

    ``members``: key, id, look, component; ``look`` tells the sets of an id apart. The largest component of a bucket is not compared with itself.
    The others and it are cut into blocks by hash, and a tile is a pair of blocks: at most about 2 x TILE rows each.
    """
    own = members.join(blocks, "key").withColumn("in_main", F.col("component") == F.col("main"))
    spread = F.pmod(F.xxhash64("id"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    own = own.withColumn("block", F.when(F.col("in_main"), F.col("others") + spread).otherwise(spread))
    # the blocks that a block meets: those of the main component only the others, the others all
    facing = F.when(F.col("in_main"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))
    dealt = own.withColumn("face", F.explode(facing)).withColumn("t1", F.least("block", "face")).withColumn("t2", F.greatest("block", "face"))
    dealt = dealt.select("key", "t1", "t2", "block", "id", "look", "component")
    names, small = dealt.columns, stage(_small_looks(looks))
    seen = dealt.join(small, ["id", "look"]).select(*dealt.columns, "n", "bands", "short")
    least = share / 100 - 4.5 * (share / 100 * (1 - share / 100) / SLOTS) ** 0.5

    def pairs_of(table: pa.Table) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each tile the rows with the partners whose signatures allow a link, and the share of equal slots."""
        key, t1, t2, block, ids, comp, n = (table.column(c).to_numpy() for c in ("key", "t1", "t2", "block", "id", "component", "n"))
        bands = np.frombuffer(b"".join(table.column("bands").to_pylist()), np.uint32).reshape(-1, BANDS)
        short = np.frombuffer(b"".join(table.column("short").to_pylist()), np.uint8).reshape(-1, SLOTS)
        low = (key.astype(np.uint64) & _U(0xFFFFFFFF)).astype(np.uint32)
        edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1]), True])
        for a, b in zip(edges[:-1], edges[1:]):
            own = block[a:b] == t1[a]
            left = a + np.flatnonzero(own)
            right = left if t1[a] == t2[a] else a + np.flatnonzero(~own)
            found = []
            for i in left:
                j = right[(comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= share * np.maximum(n[right], n[i]))]
                if t1[a] == t2[a]:
                    j = j[ids[j] > ids[i]]
                if len(j):
                    # a pair belongs to the first bucket that it shares
                    first = (bands[j] == bands[i]).argmax(axis=1)
                    j = j[bands[j, first] == low[a]]
                if len(j):
                    same = (short[j] == short[i]).mean(axis=1)
                    j, same = j[same >= least], same[same >= least]
                if len(j):
                    found.append((i, j, same))
            yield found

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, ["key", "t1", "t2"]):
            rows = [x for found in pairs_of(table) for i, j, _ in found for x in (np.array([i]), j)]
            if rows:
                yield from table.select(names).take(np.unique(np.concatenate(rows))).combine_chunks().to_batches()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, ["key", "t1", "t2"]):
            comp = table.column("component").to_numpy()
            items = table.column("items").combine_chunks()
            full = lambda i: np.frombuffer(items[int(i)].as_buffer(), np.uint64)  # noqa: B023, E731
            links = []
            for found in pairs_of(table):
                root: dict[int, int] = {}

                def find(c: int) -> int:
                    while root.setdefault(c, c) != c:  # noqa: B023
                        root[c] = root[root[c]]  # noqa: B023
                        c = root[c]  # noqa: B023
                    return c

                tried = sorted(((-s, int(i), int(k)) for i, j, same in found for k, s in zip(j, same.tolist())))
                for _, i, k in tried:
                    p, q = find(int(comp[i])), find(int(comp[k]))
                    if p != q and alike(full(i), full(k), share):
                        root[p] = q
                        links.append((int(comp[i]), int(comp[k])))
            if links:
                a, b = zip(*links)
                yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    tiled = lambda df: df.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2")
    flagged = stage(tiled(seen).mapInArrow(near, dealt.schema))
    found = stage(tiled(flagged.join(small, ["id", "look"]).join(sets, ["id", "look"]).select(*seen.columns, "items")).mapInArrow(link, "a long, b long"))
    for done in (small, flagged):
        unstage(done)
    return found


def _small_looks(looks: DataFrame) -> DataFrame:
    """The lower half of each band's key and of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = lambda name, kind: pa.array([np.frombuffer(x, kind)[::2].tobytes() for x in batch.column(name).to_pylist()], pa.binary())  # noqa: B023, E731
            yield pa.record_batch({"id": batch.column("id"), "look": batch.column("look"), "n": batch.column("n"), "bands": half("bands", "<u4"), "short": half("short", "<u1")})

    return looks.select("id", "look", "n", "bands", "short").mapInArrow(run, "id long, look int, n long, bands binary, short binary")


def link_groups(docs: DataFrame, size: int = 5, share: int = 80, doc_id: str = "doc_id", text: str = "text", star_rounds: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row.

    Texts are linked when 100 * intersection >= ``share`` * union of their sets of ``size``-word shingles. Rows that share
    an id are one document with several texts and have one component. Rows with a null id, and rows without words, are linked
    with nothing: the component is their own id. An empty table gives no rows.
    """
    own = slim(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(_sign(own, size))
    full = signed.where("same IS NOT NULL AND doc_id IS NOT NULL")
    # one representative for each set: the smallest id
    reps = stage(full.groupBy("same").agg(F.min(F.struct("doc_id", "n", "bands", "short")).alias("r")).select("same", F.hash("same").alias("look"), F.col("r.doc_id").alias("id"), "r.n", "r.bands", "r.short"))
    # an id may stand for several sets, or belong to the set of another id; both are links of their own
    alike_ids = full.select("doc_id", "same").join(reps.select("same", F.col("id").alias("rep")), "same").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    keyed = _unfold(reps)
    # written before it is joined, here and below: then the join shuffles both sides and Spark can split a hot key
    buckets = stage(keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key", "low"))
    met = stage(keyed.join(buckets, "key").select("key", "id", "look", "low"))
    candidates = met.select("id").distinct()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Words()
        for batch in batches_of(batches, "text"):
            sets = [shingle_set(t, size, hashes).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"id": batch.column("doc_id"), "same": pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), "items": pa.array(sets, pa.binary())})

    # ids with several texts give several sets; a link of any of them is a link of the document
    sets = stage(own.join(candidates.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInArrow(take, "id long, same binary, items binary").distinct().select("id", F.hash("same").alias("look"), "items"))

    tried = blocks = former_left = None
    members = met.select("key", "id", "look", F.col("id").alias("component"))
    for k in range(star_rounds):
        # one partner for each member: of the partners that its buckets name, the one that most of them do; a bucket names its
        # smallest id, in later rounds its smallest by another hash
        if blocks is None:
            named = met.select("id", F.col("id").alias("component"), F.col("low").alias("partner"), F.col("low").alias("other"))
        else:
            named = members.join(blocks.select("key", "partner"), "key").select("id", "component", F.col("partner.id").alias("partner"), F.col("partner.component").alias("other"))
        # the rows of an id, at most one for each band, stay together for both sums
        named = named.where("component <> other").repartition("id").groupBy("id", "partner", "component", "other").agg(F.count(F.lit(1)).alias("n"))
        pairs = named.select("id", "n", F.greatest("id", "partner").alias("a"), F.least("id", "partner").alias("b"), F.greatest("component", "other").alias("c"), F.least("component", "other").alias("to"))
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        best = stage(pairs.groupBy("id").agg(F.max(F.struct("n", "a", "b", "c", "to")).alias("best")).select("best.a", "best.b", "best.c", "best.to").distinct())
        if best.isEmpty():
            break
        seen = stage(confirmed(best, sets, share))
        unstage(best)
        tried = seen if tried is None else tried.unionAll(seen)
        former = [met] if blocks is None else [members, blocks]
        members = _relabel(members, seen.where("ok").select("c", "to"))
        for done in former:
            unstage(done)
        blocks = stage(_blocks(members, F.xxhash64("id", F.lit(k + 1))))
        left, rows = blocks.agg(F.sum("pairs"), F.sum("n_all")).first()
        # the rounds save comparisons in tiles: few of them are done there at once, and so are those that a round hardly lessens
        if left is None or left <= PAIRS * rows or (former_left is not None and left > 0.75 * former_left):
            break
        former_left = left
    links = alike_ids
    if tried is not None:
        # between components, whose names are ids: shorter ways to the smallest one than between the ids
        links = links.unionAll(tried.where("ok").select(F.col("c").alias("a"), F.col("to").alias("b")))
    if blocks is not None and not blocks.isEmpty():
        links = links.unionAll(_tile_links(members, blocks, reps, sets, share))
    labels = stage(components(links))
    for done in [buckets, sets, reps] + ([met] if blocks is None else [members, blocks]):
        unstage(done)
    named = signed.join(labels.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    found = F.coalesce("component", "doc_id")
    return named.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"), found.eqNullSafe(F.col("doc_id")).alias("kept"))


def _relabel(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members with the component that theirs is linked with: the smallest, and then the smallest that this one is linked with.

    ``links``: pairs of components, ``c`` > ``to``. Equal names stand for members that are linked; those of a longer chain may keep
    different names for now, which costs comparisons and no link.
    """
    first = stage(links.groupBy("c").agg(F.min("to").alias("to")))
    second = stage(first.join(first.select(F.col("c").alias("to"), F.col("to").alias("then")), "to", "left").select("c", F.coalesce("then", "to").alias("to")))
    found = stage(members.join(second.withColumnRenamed("c", "component"), "component", "left").select("key", "id", "look", F.coalesce("to", "component").alias("component")))
    unstage(first)
    unstage(second)
    return found


def keep_one(docs: DataFrame, size: int = 5, share: int = 80, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are no near copy of a document with a smaller id, with all their columns.

    All rows of an id that stays are kept, and rows of a null id always are.
    """
    found = link_groups(docs, size, share, doc_id, text, **options)
    dropped = found.where("NOT kept").select(F.col("doc_id").alias("__dropped")).distinct()
    return docs.join(dropped, F.col(f"`{doc_id}`").cast("long") == F.col("__dropped"), "left_anti")
