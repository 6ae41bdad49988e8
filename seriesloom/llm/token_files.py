"""Token ids as flat binary files: unsigned integers, with 64-bit document offsets beside them.

Each part has three files: ``part-K.ids`` (unsigned 16-bit ids, little-endian, or 32-bit for vocabularies above
65,536), ``part-K.off`` (unsigned 64-bit: the global start of each document, and the end of the last) and
``part-K.doc`` (64-bit document ids). ``index.json`` lists the parts with their first document, base and counts.
Parts follow each other in ascending document id. Documents are encoded where they are read, and only
the ids are shuffled, by ranges of the document id. A part's base is the prefix sum of the parts before it.

Files are written under a name of their own and then moved, so that a task that runs again replaces a part with equal
content. Any file system that pyarrow knows will do; local ones are memory-mapped on reading.
"""

from __future__ import annotations

import functools
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.tables import batches_of, slim, stage
from seriesloom.session import shared_folder

#: separators for Arrow's split, not for the vocabulary's pattern
SEPARATORS = "[\x1c-\x1f]"
SPACES = "[ \t\r\n]+"
#: an ASCII word and the marks behind it, which the vocabulary's pattern always parts: no apostrophe (endings such as 's), no bar (special tokens)
WORD_AND_MARKS = r"^(?P<word>[A-Za-z]+)(?P<marks>[!-&(-/:-@\[-`{}~]*)$"


def pieces_of(texts: pa.Array) -> pa.ListArray:
    """The texts cut at white space."""
    odd = pc.any(pc.match_substring_regex(texts, SEPARATORS)).as_py()
    return pc.split_pattern_regex(texts, SPACES) if odd else pc.utf8_split_whitespace(texts)


def store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path inside it, of a URI or a plain path."""
    return fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)


def write_file(path: str, data: bytes) -> None:
    system, place = store(path)
    draft = f"{place}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(data)
    if isinstance(system, fs.LocalFileSystem):
        import os

        os.replace(draft, place)  # atomic, also over a file of an earlier attempt
    else:
        if system.get_file_info(place).type != fs.FileType.NotFound:
            system.delete_file(place)
        system.move(draft, place)


def read_array(path: str, kind: str) -> np.ndarray:
    """A whole file as an array, memory-mapped where the file system is local."""
    system, place = store(path)
    if system.get_file_info(place).size == 0:
        return np.zeros(0, kind)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(place, kind, "r")
    with system.open_input_file(place) as source:
        return np.frombuffer(source.read(), kind)


class WordEncoder:
    """Encode texts with a tokenizers file whose tokens never cross white space.

    The vocabulary lowers its texts, drops white space and merges inside words only, so a text's ids are those of its
    space-separated pieces, one after the other. New words of ASCII letters go to the file's model at once, since its
    normalising and cutting leave them as they are; other new pieces are encoded many at a time, parted by a mark that has one token of
    its own. Pieces are remembered in two generations of at most ``most`` each, so that frequent ones stay.
    """

    MARK = "|"

    def __init__(self, path: str, kind: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.most, self.young, self.old = Tokenizer.from_file(path), kind, most, {}, {}
        (self.mark,) = self.ids([self.MARK])[0]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [got.ids for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: set[str]) -> None:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        new = pieces - self.young.keys()
        again = new & self.old.keys()
        self.young.update((p, self.old[p]) for p in again)
        new -= again
        plain = [p for p in new if p.isascii() and p.isalpha()]
        model = self.tokenizer.model
        self.young.update((p, np.array([t.id for t in model.tokenize(p.lower())], self.kind).tobytes()) for p in plain)
        new.difference_update(plain)
        alone = [p for p in new if self.MARK in p]
        for piece, got in zip(alone, self.ids(alone)):
            self.young[piece] = np.array(got, self.kind).tobytes()
        rest = [p for p in new if self.MARK not in p]
        groups = [rest[k : k + 500] for k in range(0, len(rest), 500)]
        for group, got in zip(groups, self.ids([f" {self.MARK} ".join(g) for g in groups])):
            row = np.array(got, self.kind)
            edges = np.concatenate([[-1], np.flatnonzero(row == self.mark), [len(row)]])
            size = row.itemsize
            flat = row.tobytes()
            for piece, a, b in zip(group, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                self.young[piece] = flat[(a + 1) * size : b * size]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Arrow numbers the distinct pieces of all texts; their ids are gathered by offsets."""
        cut = pieces_of(pa.array(texts, pa.string()))
        pieces = cut.flatten().dictionary_encode()
        distinct, at = pieces.dictionary, pieces.indices.to_numpy(zero_copy_only=False)
        parted = pc.extract_regex(distinct, WORD_AND_MARKS)
        # by way of numpy, which makes strings several times faster than to_pylist
        words = pc.coalesce(pc.ascii_lower(pc.struct_field(parted, "word")), distinct).to_numpy(zero_copy_only=False).tolist()
        marks = pc.fill_null(pc.struct_field(parted, "marks"), "").to_numpy(zero_copy_only=False).tolist()
        self.learn({*words, *marks})
        known = [self.young[w] + self.young[m] for w, m in zip(words, marks)]
        size = np.array([len(k) for k in known], np.int64) // np.dtype(self.kind).itemsize
        flat, first = np.frombuffer(b"".join(known), self.kind), np.cumsum(size) - size
        each = size[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(first[at] - ends[:-1], each) + np.arange(ends[-1])]
        edges = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))]).astype(np.int64)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]


@functools.lru_cache(maxsize=2)
def word_encoder(path: str, kind: str) -> WordEncoder:
    """One encoder for each Python worker, kept from task to task."""
    return WordEncoder(path, kind)


def write_tokens(docs: DataFrame, folder: str, encoder: Callable[[], Callable[[list[str]], list[bytes]]], end_id: int, wide: bool = False, parts: int | None = None, doc_id: str = "doc_id", text: str = "text") -> dict:
    """Encode ``docs`` into files below ``folder``; returns the index, which is also written as ``index.json``.

    Null texts count as empty and give the end id alone. Documents with a null id come first, stored as the smallest
    64-bit number; repeated ids keep all their rows, ordered by their ids. An empty table gives an index without parts.
    """
    kind = "<u4" if wide else "<u2"
    spark = docs.sparkSession
    own = slim(docs, doc_id=doc_id, text=text).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # borders of the parts from the ids alone; they only steer how even the parts are
    bounds = own.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    bounds = sorted(set(bounds))[: parts - 1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last = encoder(), np.array([end_id], kind).tobytes()
        for batch in batches_of(batches, "text"):
            ids = [x + last for x in run(batch.column("text").to_pylist())]
            at = np.searchsorted(np.array(bounds, np.int64), batch.column("doc_id").to_numpy(zero_copy_only=False), "right")
            yield pa.record_batch({"part": pa.array(at, pa.int32()), "doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary())})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, names, docs_in, sizes, tokens = None, [], [], [], 0
        part = TaskContext.get().partitionId()
        place, draft = f"{folder}/part-{part:06d}", f"{folder}/part-{part:06d}.ids.{uuid.uuid4().hex}"
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if system is None:
                system, inside = store(draft)
                out = system.open_output_stream(inside)
            for ids in batch.column("ids"):
                out.write(ids.as_buffer())
                sizes.append(len(ids.as_buffer()) // np.dtype(kind).itemsize)
            docs_in.append(batch.column("doc_id").to_numpy(zero_copy_only=False))
        if system is None:
            return
        out.close()
        final = store(f"{place}.ids")[1]
        if not isinstance(system, fs.LocalFileSystem) and system.get_file_info(final).type != fs.FileType.NotFound:
            system.delete_file(final)
        system.move(inside, final)
        names, tokens = np.concatenate(docs_in).astype("<i8"), int(sum(sizes))
        write_file(f"{place}.doc", names.tobytes())
        write_file(f"{place}.len", np.array(sizes, "<u8").tobytes())
        yield pa.record_batch({"part": pa.array([part], pa.int32()), "docs": pa.array([len(sizes)], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    def place_offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist()):
                sizes = read_array(f"{folder}/part-{part:06d}.len", "<u8")
                write_file(f"{folder}/part-{part:06d}.off", (np.concatenate([[0], np.cumsum(sizes)]).astype("<u8") + np.uint64(base)).tobytes())
            yield batch

    system, inside = store(folder)
    system.create_dir(inside, recursive=True)
    coded = own.mapInArrow(encode, "part int, doc_id long, ids binary")
    sorted_parts = coded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("doc_id", "ids")
    # one row for each part
    found = sorted(sorted_parts.mapInArrow(write, "part int, docs long, tokens long").collect())
    index, base, first = [], 0, 0
    for part, count, tokens in found:
        index.append({"part": part, "base": base, "first_doc": first, "docs": count, "tokens": tokens})
        base, first = base + tokens, first + count
    if index:
        listed = spark.createDataFrame([(x["part"], x["base"]) for x in index], "part int, base long").repartition(len(index))
        listed.mapInArrow(place_offsets, "part int, base long").write.format("noop").mode("overwrite").save()
    whole = {"kind": kind, "end_id": end_id, "docs": first, "tokens": base, "parts": index}
    write_file(f"{folder}/index.json", json.dumps(whole).encode())
    return whole


def read_tokens(spark: SparkSession, folder: str, index: dict) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read from the files alone."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not index["parts"]:
        return spark.createDataFrame([], schema)
    kind = index["kind"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("part").to_pylist():
                place = f"{folder}/part-{part:06d}"
                ids, off, names = read_array(f"{place}.ids", kind), read_array(f"{place}.off", "<u8").astype(np.int64), read_array(f"{place}.doc", "<i8")
                for k in range(0, len(names), 20_000):
                    edges = off[k : k + 20_001]
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(edges[:-1] - off[0], edges[1:] - off[0])]
                    some = names[k : k + len(crc)]
                    yield pa.record_batch(
                        {"doc_id": pa.array(some, pa.int64(), mask=np.asarray(some) == -(2**63)), "start": pa.array(edges[:-1]), "n_tokens": pa.array(np.diff(edges)), "ids_crc32": pa.array(crc, pa.int64())}
                    )

    parts = spark.createDataFrame([(x["part"],) for x in index["parts"]], "part int").repartition(len(index["parts"]))
    return parts.mapInArrow(read, schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write ``docs`` with a tokenizers file and read the files back."""
    folder = folder or shared_folder(docs.sparkSession)
    index = write_tokens(docs, folder, lambda: word_encoder(tokenizer, "<u2"), end_id)
    return read_tokens(docs.sparkSession, folder, index)
