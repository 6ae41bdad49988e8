"""Size-balanced shards: the minimax contiguous partition of ordered atomic groups.

Equal texts form a group, which is divided only where its copies together exceed an equal share of all bytes. Groups are ordered by the hash of their text (texts
whose hashes collide simply share a group). The smallest capacity with which a greedy walk over the ordered
sizes needs no more than the given number of shards is found by binary search. The cuts then stay within that
capacity and, where it leaves room, lie next to equal shares of what remains.

A walk needs to know the borders between groups only where it stops. So the driver starts with the sums of 4096
cells of the hash space and asks Spark for finer cells wherever a walk stopped in a cell of several groups,
until no walk does. What it holds is bounded by shards x search steps x cells, whatever the number of groups.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.tables import slim, stage

OVERHEAD = 8
FIRST_BITS, MORE_BITS = 12, 8


class Borders:
    """Sums up to each border between cells; remembers in which cells walks stopped."""

    def __init__(self, sizes: list[int]):
        self.at = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
        self.touched: set[int] = set()

    def last_up_to(self, position: int) -> int:
        i = int(np.searchsorted(self.at, position, "right")) - 1
        if i < len(self.at) - 1:
            self.touched.add(i)
        return i

    def first_from(self, position: int) -> int:
        i = int(np.searchsorted(self.at, position, "left"))
        if i > 0:
            self.touched.add(i - 1)
        return i

    def fits(self, capacity: int, shards: int) -> bool:
        """Greedy check: does each shard, filled as far as it goes, leave nothing over?"""
        i = 0
        for _ in range(shards):
            i = self.last_up_to(int(self.at[i]) + capacity)
            if i == len(self.at) - 1:
                return True
        return False

    def capacity(self, shards: int, largest: int) -> int:
        total = int(self.at[-1])
        low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
        while low < high:
            middle = (low + high) // 2
            if self.fits(middle, shards):
                high = middle
            else:
                low = middle + 1
        return low

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Border at the end of each shard."""
        total, least = int(self.at[-1]), [len(self.at) - 1]
        for _ in range(shards - 1):  # from the end: before which border the rest would not fit
            least.append(self.first_from(int(self.at[least[-1]]) - capacity))
        least = least[::-1]
        ends, i = [], 0
        for j in range(shards):
            most = self.last_up_to(int(self.at[i]) + capacity)
            aim = int(self.at[i]) + (total - int(self.at[i])) / (shards - j)
            below, above = self.last_up_to(math.floor(aim)), self.first_from(math.ceil(aim))
            near = below if aim - self.at[below] <= self.at[above] - aim else above
            i = min(max(near, least[j], i), most)
            ends.append(i)
        return ends


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(capacity, number of hash values below the end of each shard) of a staged table of groups ``h``, ``size``."""

    def cells(bits: int, within: list[int] | None) -> list[tuple[int, int, int, int]]:
        """(prefix, bits, size, groups) of the non-empty cells, all or those within longer cells."""
        own = groups.select(F.shiftrightunsigned("h", 64 - bits).alias("cell"), "h", "size")
        if within is not None:
            listed = groups.sparkSession.createDataFrame([(w,) for w in within], "above long")
            # at most shards x search steps rows
            own = own.join(F.broadcast(listed), F.shiftrightunsigned("h", 64 - bits + MORE_BITS) == F.col("above"), "left_semi")
        rows = own.groupBy("cell").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
        return [(r.cell % 2**64 << (64 - bits), bits, r.size, r.n) for r in rows]

    largest = groups.agg(F.max("size")).first()[0]
    if largest is None:
        return 0, [0] * (shards - 1) + [2**64]
    known = sorted(cells(FIRST_BITS, None))
    while True:
        borders = Borders([size for _, _, size, _ in known])
        capacity = borders.capacity(shards, largest)
        ends = borders.cuts(capacity, shards)
        coarse = {known[i][:2] for i in borders.touched if known[i][3] > 1 and known[i][1] < 64}
        if not coarse:
            starts = [low for low, *_ in known] + [2**64]
            return capacity, [starts[i] for i in ends[:-1]] + [2**64]
        known = [c for c in known if c[:2] not in coarse]
        for bits in sorted({b for _, b in coarse}):
            more = min(64, bits + MORE_BITS)
            known += cells(more, [low >> (64 - bits) for low, b in coarse if b == bits])
        known.sort()


def assign_shards(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", rows_per_block: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and capacity for each row.

    ``size`` is the text's length in UTF-8 bytes (null as empty) plus 8. Null and empty texts are one group, as are
    all rows of an equal text, repeated ids included; null ids sort first. A group is never divided, at any size, so shards are near
    equal up to the largest group, below which ``capacity`` cannot be. Slots number a shard's
    rows without gaps: rows are dealt to blocks by a hash of id and text, numbered inside the block, and
    moved by the count of the blocks before it, so that no task holds a shard. With fewer groups than shards
    some shards stay empty; an empty table gives no rows.
    """
    body = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = stage(
        slim(docs, doc_id=doc_id, text=text).select(
            "doc_id", F.xxhash64(body).alias("h"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32")
        )
    )
    groups = stage(rows.groupBy("h").agg(F.sum("size").alias("size")))
    capacity, ends = minimax_cuts(groups, shards)
    # the order of unsigned hashes, as longs
    place = F.col("h").bitwiseXOR(F.lit(-(2**63)))
    shard = sum(((place >= F.lit(end - 2**63)).cast("int") for end in ends[:-1] if end < 2**64), F.lit(0))
    blocks = max(1, rows.count() // (shards * rows_per_block))
    dealt = rows.withColumn("shard", shard).withColumn("block", F.pmod(F.xxhash64("doc_id", "h"), F.lit(blocks)).cast("int"))
    counts = dealt.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "block", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "h")) - 1
    return (
        dealt.withColumn("inside", inside)
        .join(offsets, ["shard", "block"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("inside")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity"),
        )
    )
