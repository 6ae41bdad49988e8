"""Exact deduplication: two Bloom passes, then only possible repeats are shuffled.

Pass one sets bits for the hash of every text. Each task combines its own bits first (a text that it
meets twice is marked at once), tasks' bits meet by segment of the filter, and a bit that two
tasks set, or one task set twice, goes into the filter of repeats. Pass two probes it: a text of which
a bit is missing is unique and its row passes straight through; the other rows are grouped by the
SHA-256 of the whole normalised text, so false positives of the filter cost a shuffle, never a result.

The filter of repeats is broadcast. Its size is bounded by ``filter_bytes``: when the rows need more
bits, the hash space is cut into slices, which are written to folders of their own: each slice has its filter and
reads its own rows only, so the work grows with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import lower_az, stage, stage_slices

SEGMENT_BITS = 1 << 16


def text_key(text: str):
    """Lowercase hex SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(lower_az(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("binary"), 256)


def _positions(keys: pa.Array, bits: int) -> np.ndarray:
    """Two filter positions for each hex digest, from its first 120 bits."""
    digest = np.frombuffer("".join(keys.to_pylist()).encode(), dtype="S64")
    high = np.array([int(k[:15], 16) for k in digest], dtype=np.uint64)
    low = np.array([int(k[15:30], 16) for k in digest], dtype=np.uint64)
    return np.stack([high % np.uint64(bits), low % np.uint64(bits)], axis=1).astype(np.int64)


def repeat_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """Packed bits that are set for each ``sha`` that occurs more than once (and for a few others)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            # each filter position counts once a text; the two positions of a text may be the same
            at, count = np.unique(_positions(batch.column(0), bits), return_counts=True)
            own = (once[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            again = at[(count > 1) | (own == 1)]
            np.bitwise_or.at(twice, again >> 3, (1 << (again & 7)).astype(np.uint8))
            np.bitwise_or.at(once, at >> 3, (1 << (at & 7)).astype(np.uint8))
        where = np.flatnonzero(np.unpackbits(once, bitorder="little"))
        flag = (twice[where >> 3] >> (where & 7).astype(np.uint8)) & 1
        segment, start = np.unique(where >> 16, return_index=True)
        ends = np.append(start[1:], len(where))
        yield pa.record_batch(
            {
                "segment": pa.array(segment, pa.int64()),
                "offsets": pa.array([(where[a:b] & 0xFFFF).astype("<u2").tobytes() for a, b in zip(start, ends)], pa.binary()),
                "twice": pa.array([np.packbits(flag[a:b]).tobytes() for a, b in zip(start, ends)], pa.binary()),
            }
        )

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(SEGMENT_BITS, np.uint8)
        for batch in parts:
            for offsets, twice in zip(batch.column("offsets").to_pylist(), batch.column("twice").to_pylist()):
                at = np.frombuffer(offsets, "<u2")
                count[at] = np.minimum(count[at] + 1 + np.unpackbits(np.frombuffer(twice, np.uint8))[: len(at)], 2)
        packed = np.packbits(count > 1, bitorder="little").tobytes()
        if any(packed):
            yield pa.record_batch({"segment": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([packed], pa.binary())})

    parts = keys.select("sha").mapInArrow(mark, "segment long, offsets binary, twice binary")
    merged = parts.groupBy("segment").applyInArrow(merge, "segment long, bits binary")
    found = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        at = row.segment * SEGMENT_BITS // 8
        found[at : at + SEGMENT_BITS // 8] = np.frombuffer(row.bits, np.uint8)
    return found


def flag_repeats(keys: DataFrame, bits_per_row: int = 16, filter_bytes: int = 32_000_000) -> DataFrame:
    """Add ``maybe``: false only for rows whose ``sha`` occurs once. ``keys`` has to be a staged table."""
    spark = keys.sparkSession
    rows = max(1, keys.count())
    slices = math.ceil(rows * bits_per_row / (filter_bytes * 8))
    bits = math.ceil(min(rows * bits_per_row, filter_bytes * 8) / SEGMENT_BITS) * SEGMENT_BITS
    out = None
    for part in [keys] if slices == 1 else stage_slices(keys, F.col("sha"), slices):
        shared = spark.sparkContext.broadcast(repeat_filter(part, bits))

        def probe(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    at = _positions(batch.column("sha"), bits)
                    maybe = ((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], names=[*batch.schema.names, "maybe"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema) + ", maybe boolean"
        probed = part.mapInArrow(probe, schema)
        out = probed if out is None else out.unionAll(probed)
    return out


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row.

    Of equal texts (A-Z lower-cased, null as empty) the row with the largest id stays. A null id is
    smaller than any other. Rows that repeat an id together with its text can't be told apart
    here and share one verdict; ``deduplicate`` leaves one of them. An empty table gives no rows.
    """
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_key(text).alias("sha"))
    flagged = stage(flag_repeats(stage(slim), **limits))
    alone = flagged.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    rest = flagged.where("maybe").select("doc_id", "sha")
    # written before it is joined, so that the join shuffles both sides and Spark can split a hot text
    groups = stage(rest.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    met = rest.join(groups, "sha").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionAll(met)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each text, that of the largest id.

    Equal ids are decided by the text and then by the other columns that have an order. Unique rows pass straight
    through; of the rest, each task keeps its own winner of a text before anything is shuffled.
    """
    keys = stage(docs.select(text_key(text).alias("sha")))
    rows, size = max(1, keys.count()), limits.get("filter_bytes", 32_000_000) * 8
    per_row = limits.get("bits_per_row", 16)
    slices = math.ceil(rows * per_row / size)
    bits = math.ceil(min(rows * per_row, size) / SEGMENT_BITS) * SEGMENT_BITS
    marked = docs.withColumn("__sha", text_key(text))
    order = [F.col(f"`{doc_id}`"), F.col(f"`{text}`")] + [F.col(f"`{f.name}`") for f in docs.schema if f.name not in (doc_id, text) and f.dataType.typeName() not in ("map", "variant")]
    out = None
    # with several slices, the documents are written once by slice, with their keys
    for part in [None] if slices == 1 else stage_slices(marked, F.col("__sha"), slices):
        own, whole = (keys, marked) if part is None else (part.select(F.col("__sha").alias("sha")), part)
        shared = docs.sparkSession.sparkContext.broadcast(repeat_filter(own, bits))

        @F.pandas_udf("boolean")
        def maybe(sha, shared=shared):
            import pandas as pd

            at = _positions(pa.array(sha), bits)
            return pd.Series(((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1))

        probed = whole.withColumn("__maybe", maybe("__sha"))
        alone = probed.where(~F.col("__maybe")).select(*[F.col(f"`{c}`") for c in docs.columns])
        best = probed.where("__maybe").groupBy("__sha").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(*order)).alias("row"))
        done = alone.unionAll(best.select("row.*"))
        out = done if out is None else out.unionAll(done)
    return out
