"""Statement files: delimited text with a preamble, drifting headers, and ZIP archives of such files."""

from __future__ import annotations

import csv
import io
import itertools
import uuid
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.cleaning import snake_case
from seriesloom.session import stage

LINES = "file string, pos struct<block: bigint, row: bigint>, line string"


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Raw lines of many text files with their file and place; large files are split."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("pos"), F.col("value").alias("line"))


def file_heads(lines: DataFrame, sep: str, header_pattern: str, skip: int) -> DataFrame:
    """One row for each file: the first line after ``skip`` lines that looks like a header, its place, its fields."""
    opening = lines.where("pos.block = 0")
    first = opening.groupBy("file").agg(F.min("pos.row").alias("_top"))
    like = lines.where(F.col("line").rlike(header_pattern) & F.col("line").contains(sep))
    if skip:
        like = like.join(first, "file").where((F.col("pos.block") > 0) | (F.col("pos.row") - F.col("_top") >= skip))
    return stage(like.groupBy("file").agg(F.min(F.struct("pos", "line")).alias("h")).select("file", F.col("h.pos").alias("_at"), F.col("h.line").alias("_header")))


def _body(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Lines after the header of their file that are not blank."""
    return lines.join(heads, "file").where((F.col("pos") > F.col("_at")) & (F.trim("line") != ""))


def parse_lines(
    lines: DataFrame,
    sep: str = ";",
    columns: Sequence[str] | None = None,
    row_pattern: str = r'^"?[0-9]{6}',
    header_pattern: str = r'^"?#?[A-Za-z_]+.*',
    skip: int = 0,
) -> DataFrame:
    """Turn lines into one wide table, whatever column layout each file has.

    A file's header is its first line, after ``skip`` lines, that looks like one; what precedes it is preamble. The header
    names the file's own fields, so a column that a file lacks is NULL there, as are the last fields of
    a row that has fewer. Fields of rows and headers may be quoted, but not hold line breaks. ``columns`` gives the cleaned names to
    keep; without it all names found in the headers are used. Lines after the header that do not match ``row_pattern`` are left
    to ``rejected_lines``; a row with more fields than its header keeps the named ones, and its line is listed there as well.
    """
    heads = file_heads(lines, sep, header_pattern, skip)
    # a handful of layouts, not data
    layouts = {r["_header"]: [n.strip() for n in next(csv.reader([r["_header"]], delimiter=sep))] for r in heads.select("_header").distinct().collect()}
    if columns is None:
        columns = list(dict.fromkeys(snake_case(n) for h in sorted(layouts) for n in layouts[h]))
    width = max(map(len, layouts.values()), default=1)
    schema = ", ".join(f"c{i} string" for i in range(width))
    fields = lambda line: F.from_csv(line, schema, {"sep": sep, "quote": '"', "mode": "PERMISSIVE"})
    # names are made once for a layout; a row has its layout's number and knows by it which field is which
    named = F.transform(F.slice(F.array(*[F.col(f"_h.c{i}") for i in range(width)]), 1, F.col("_n")), lambda n: _snake_column(F.trim(n)))
    made = heads.select("_header").distinct().select("_header", F.size(_open_fields("_header", sep)).alias("_n"), fields("_header").alias("_h")).select("_header", named.alias("_names"))
    names = {r["_header"]: r["_names"] for r in made.collect()}
    number = {h: i for i, h in enumerate(sorted(names))}
    numbered = heads.select("file", "_at", F.coalesce(*[F.when(F.col("_header") == F.lit(h), F.lit(i)) for h, i in number.items()], F.lit(None)).cast("int").alias("_layout"))
    # inline holds back filters on fields, which would else be moved below and parse the line once more for each field they name
    rows = _body(lines, numbered).where(F.col("line").rlike(row_pattern)).select("file", "_layout", F.inline(F.array(fields("line"))))

    def value(name: str) -> Column:
        cell = F.lit(None).cast("string")
        for header, i in number.items():
            found = names[header]
            if None in found or len(set(found)) < len(found):
                here = F.raise_error(F.lit(f"a header without a name for each field, or with one twice: {header}")).cast("string")
            elif name in found:
                here = F.col(f"c{found.index(name)}")
            else:
                continue
            cell = F.when(F.col("_layout") == i, here).otherwise(cell)
        return F.nullif(F.trim(cell), F.lit(""))

    return rows.select("file", *[value(name).alias(name) for name in dict.fromkeys(columns)])


def _open_fields(line: str, sep: str) -> Column:
    """The fields of a line, with a letter in place of each quoted text."""
    return F.split(F.regexp_replace(line, '"[^"]*"', "q"), _literal(sep))


def rejected_lines(lines: DataFrame, sep: str = ";", row_pattern: str = r'^"?[0-9]{6}', header_pattern: str = r'^"?#?[A-Za-z_]+.*', skip: int = 0) -> DataFrame:
    """Lines after the header that are no rows, rows with more fields than their header (but for empty ones at the end), and all
    lines of files without a header, with their file."""
    heads = file_heads(lines, sep, header_pattern, skip)
    surplus = F.filter(_open_fields("line", sep), lambda f, i: (i >= F.size(_open_fields("_header", sep))) & (F.trim(f) != ""))
    odd = _body(lines, heads).where(~F.col("line").rlike(row_pattern) | (F.size(surplus) > 0)).select("file", "line")
    return odd.unionByName(lines.join(heads, "file", "left_anti").where(F.trim("line") != "").select("file", "line"))


def read_statements(spark: SparkSession, path: str | Sequence[str], sep: str = ";", **kw) -> DataFrame:
    """Read preamble files below ``path`` into one wide string table plus ``file``."""
    return parse_lines(read_lines(spark, path), sep, **kw)


def unzip_lines(archives: DataFrame, suffix: str = ".csv", batch_lines: int = 50_000) -> DataFrame:
    """Lines of the delimited members of ZIP archives given as ``(path, content)`` rows.

    A ZIP member cannot be read from its middle, so one archive is one task's work; lines
    leave in batches and never sit in memory together.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as archive:
                    members = [m for m in archive.namelist() if m.lower().endswith(suffix)]
                    for member in members:
                        yield from _member_lines(archive, path, member, batch_lines)

    return archives.select("path", "content").mapInArrow(expand, LINES)


def _member_lines(archive, path: str, member: str, batch_lines: int) -> Iterator[pa.RecordBatch]:
    name = f"{path}!{member}"
    with archive.open(member) as raw:
        start, pending = 0, []
        for line in itertools.chain(io.TextIOWrapper(raw, encoding="utf-8", errors="replace"), [None]):
            if line is not None:
                pending.append(line.rstrip("\r\n"))
            if pending and (line is None or len(pending) >= batch_lines):
                place = [{"block": 0, "row": start + i} for i in range(len(pending))]
                yield pa.record_batch({"file": pa.array([name] * len(pending)), "pos": pa.array(place, pa.struct([("block", pa.int64()), ("row", pa.int64())])), "line": pa.array(pending)})
                start, pending = start + len(pending), []


def read_zipped(spark: SparkSession, path: str | Sequence[str], sep: str = ";", **kw) -> DataFrame:
    """Read statement files inside the ZIP archives that match ``path``."""
    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    return parse_lines(unzip_lines(archives), sep, **kw)


def union_drift(*frames: DataFrame) -> DataFrame:
    """Stack frames whose columns differ; a missing column is NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def statement_lines(df: DataFrame, preamble: Sequence[str], sep: str = ";", quoted: Sequence[str] = (), short: bool = False, trailer: str | None = None) -> DataFrame:
    """Format rows as statement text: every task writes its own preamble and header, and its own trailer line if given.

    The columns of ``quoted`` are put in quotes; with ``short`` a last amount of zero is left out together with its separator.

    The result has one ``value`` column for ``write.text``. Tasks map to files, so the
    number of files follows the data.
    """
    names = list(df.columns)
    head = [*preamble, sep.join(names)]

    def with_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, first = None, True
        for batch in batches:
            if batch.num_rows:
                text = batch.schema
                if first:
                    yield pa.record_batch([pa.array(head, text.field(0).type)], schema=text)
                yield batch
                first = False
        if trailer and not first:
            yield pa.record_batch([pa.array([trailer], text.field(0).type)], schema=text)

    text = lambda n: F.coalesce(F.col(f"`{n}`").cast("string"), F.lit(""))
    cells = [F.concat(F.lit('"'), text(n), F.lit('"')) if n in quoted else text(n) for n in names]
    line = F.concat_ws(sep, *cells)
    if short:
        line = F.when(F.col(f"`{names[-1]}`") == 0, F.concat_ws(sep, *cells[:-1])).otherwise(line)
    body = df.select(line.alias("value"))
    return body.mapInArrow(with_head, "value string")


def pack_archives(lines: DataFrame, head_lines: int = 3, lines_per_archive: int = 200_000) -> DataFrame:
    """Pack statement text (``value``) into ZIP archives held as ``(path, content)`` rows.

    Each archive has one member that opens with the preamble and header of its task.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head: list[str] = []
        body: list[str] = []
        for batch in batches:
            values = batch["value"].tolist()
            if not head:
                head, values = values[:head_lines], values[head_lines:]
            body.extend(values)
            while len(body) >= lines_per_archive:
                yield _archive(head, body[:lines_per_archive])
                body = body[lines_per_archive:]
        if body:
            yield _archive(head, body)

    return lines.mapInPandas(pack, "path string, content binary")


def write_archives(archives: DataFrame, folder: str) -> int:
    """Write ``(path, content)`` rows as files below ``folder``; returns their number. A task that runs again replaces its files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                system, place = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
                system.create_dir(place, recursive=True)
                draft = f"{place}/_{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(content.as_buffer())
                system.move(draft, f"{place}/{name}")
            yield batch.select(["path"])

    return archives.mapInArrow(write, "path string").count()


def _archive(head: list[str], body: list[str]) -> pd.DataFrame:
    text = "\n".join([*head, *body]) + "\n"
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("statement.csv", text)
    content = blob.getvalue()
    return pd.DataFrame({"path": [f"archive-{zlib.crc32(text.encode()):08x}-{len(body)}.zip"], "content": [content]})


def _literal(sep: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in sep)


def _snake_column(name: Column) -> Column:
    """The column form of ``snake_case`` for plain ASCII headers."""
    marked = F.regexp_replace(F.trim(name), r"^[^0-9A-Za-z]", "x_")
    parted = F.regexp_replace(marked, r"([a-z0-9])([A-Z])", "$1_$2")
    return F.trim(F.regexp_replace(F.lower(parted), r"[^0-9a-z]+", "_"), F.lit("_"))
