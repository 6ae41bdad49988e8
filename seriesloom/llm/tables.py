"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.session import shared_folder, stage

__all__ = ["batches_of", "crc_of_id", "lower_az", "slim", "sorted_runs", "stage", "stage_slices", "table"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_slices(df: DataFrame, key: Column, slices: int) -> list[DataFrame]:
    """Write a table once, in a folder for each slice of the hash space of ``key``; reading a slice reads its folder only."""
    number = F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")
    path = shared_folder(df.sparkSession)
    # a few files a slice in place of one from every task; dealt by the reading task, so that copies of a text spread
    dealt = df.withColumn("__slice", number).withColumn("__spread", F.pmod(F.spark_partition_id(), F.lit(16)))
    dealt.repartition("__slice", "__spread").drop("__spread").write.partitionBy("__slice").parquet(path)
    context = df.sparkSession.sparkContext
    place = lambda k: context._jvm.org.apache.hadoop.fs.Path(f"{path}/__slice={k}")
    there = [k for k in range(slices) if place(k).getFileSystem(context._jsc.hadoopConfiguration()).exists(place(k))]
    return [df.sparkSession.read.schema(df.schema).parquet(f"{path}/__slice={k}") for k in there]


def slim(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names, so that no other column of the input can clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def crc_of_id(doc_id: Column) -> Column:
    """Unsigned crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def batches_of(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds at most about this many bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(size):
            if i > start and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole runs of equal keys of a partition that is sorted by them; as many runs at once as a batch has."""
    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        last = [held.column(k)[-1] for k in keys]
        start = held.num_rows
        while start > 0 and all(held.column(k)[start - 1] == v for k, v in zip(keys, last)):
            start -= 1
        if start:
            yield held.slice(0, start).combine_chunks()
            held = held.slice(start).combine_chunks()
    if held is not None:
        yield held.combine_chunks()
