"""Records of CSV files that may span lines, found by many tasks a file.

Where a record starts depends on all quotes before it. The lines of a file are gathered into chunks, and each chunk
is scanned for both cases, that it starts outside and that it starts inside a quoted field. In a file whose quotes are in
place both cases only swap, so the case of a chunk is the number of quotes before it, odd or even: a sum over the
chunks before it, which are narrow rows. With the case known, every chunk is cut into records by itself. What a record has in
other chunks is put together from their ends; only those ends are shuffled.

Chunks are written once, so their bounds are data: no later step depends on how Spark splits a file, which may change
when executors come and go.

A quote is in place if it opens or closes a field, or is one of two in a field. Files with others, and files whose lines
end in a carriage return alone, are named as odd; their meaning is up to the parser that reads them whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saldo.sources.scratch import discard, stored

CHUNK_BYTES = 1 << 20
_MARK = "﻿".encode()

_CHUNK = pa.schema(
    [("path", pa.string()), ("block", pa.int64()), ("chunk", pa.int64()), ("text", pa.binary()), ("swaps", pa.int32())]
    + [(name, pa.bool_()) for name in ("odd_outside", "odd_inside", "carriage", "bare")]
)
_CHUNK_SQL = (
    "path string, block bigint, chunk bigint, text binary, swaps int, "
    "odd_outside boolean, odd_inside boolean, carriage boolean, bare boolean"
)


def scan_line(line: bytes, delimiter: bytes, inside: bool) -> tuple[bool, bool]:
    """Whether a line ends inside a quoted field, and whether a quote is out of place, from how it starts."""
    pieces = line.split(b'"')
    last = len(pieces) - 1
    odd = False
    for i, piece in enumerate(pieces):
        if (i % 2 == 1) != inside:
            continue  # Inside a field anything may stand.
        if i == 0:
            odd |= last > 0 and piece != b"" and not piece.endswith(delimiter)
        elif i == last:
            odd |= piece not in (b"", b"\r") and not piece.startswith(delimiter)
        elif piece != b"":
            odd |= not (piece.startswith(delimiter) and piece.endswith(delimiter))
    return (last % 2 == 1) != inside, odd


class _Chunk:
    def __init__(self, path: str, block: int, number: int):
        self.key = (path, block, number)
        self.lines: list[bytes] = []
        self.size = 0
        # Case at the end and odd quotes, for a start outside and inside a quoted field.
        self.cases = [(False, False), (True, False)]

    def add(self, line: bytes, delimiter: bytes) -> None:
        self.lines.append(line)
        self.size += len(line) + 1
        if b'"' in line:
            scanned = [scan_line(line, delimiter, inside) for inside, _ in self.cases]
            self.cases = [(inside, odd or before) for (inside, odd), (_, before) in zip(scanned, self.cases, strict=True)]

    def row(self) -> tuple:
        head = self.lines[0] if self.key[1:] == (0, 0) else b""
        swaps, odd = int(self.cases[0][0]), [o for _, o in self.cases]
        return (*self.key, b"\n".join(self.lines), swaps, *odd, head.endswith(b"\r"), b"\r" in head[:-1])


def _gather(delimiter: bytes, chunk_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batch(chunk: _Chunk) -> pa.RecordBatch:
        return pa.record_batch([pa.array([cell], f.type) for cell, f in zip(chunk.row(), _CHUNK, strict=True)], schema=_CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows in batches:
            for path, block, line in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                if held is not None and (held.key[:2] != (path, block) or held.size >= chunk_bytes):
                    yield batch(held)
                    held = _Chunk(path, block, held.key[2] + 1 if held.key[:2] == (path, block) else 0)
                if held is None:
                    held = _Chunk(path, block, 0)
                if not held.lines and held.key[1:] == (0, 0):
                    line = line.removeprefix(_MARK)
                held.add(line, delimiter)
        if held is not None:
            yield batch(held)

    return run


_PART = pa.schema(
    [("path", pa.string()), ("block", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("first", pa.bool_()), ("record", pa.binary())]
)
_PART_SQL = "path string, block bigint, chunk bigint, kind int, first boolean, record binary"
#: A record that lies in one chunk; the ends of others: the end of a record, a whole chunk of it, and its start.
WHOLE, END, MIDDLE, START = range(4)


def cut(text: bytes, inside: bool, carriage: bool) -> Iterator[tuple[int, bytes]]:
    """The records of a chunk and the ends of those that it shares; records without any character are left out."""
    held: list[bytes] = []
    shared = open_quote = inside
    for line in text.split(b"\n"):
        if carriage:
            line = line.removesuffix(b"\r")
        held.append(line)
        if line.count(b'"') % 2:
            open_quote = not open_quote
        if not open_quote:
            record = b"\n".join(held)
            if shared or record:
                yield (END if shared else WHOLE), record
            held, shared = [], False
    if held:
        yield (MIDDLE if shared else START), b"\n".join(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, block, chunk, text, inside, carriage in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parts = list(cut(text, inside, carriage))
            first = [block == 0 and chunk == 0 and i == 0 for i in range(len(parts))]
            columns = [[path] * len(parts), [block] * len(parts), [chunk] * len(parts), [k for k, _ in parts], first, [r for _, r in parts]]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _PART, strict=True)], schema=_PART)


@dataclass(frozen=True)
class Records:
    """``path, record`` of every record after the first of its file; files with quotes out of place are only named."""

    table: DataFrame
    odd: list[str]
    #: Written tables that the records are read from, to be discarded after use.
    scratch: list[DataFrame]


def split_records(spark: SparkSession, paths: Sequence[str], delimiter: str, chunk_bytes: int = CHUNK_BYTES) -> Records:
    """The records of CSV files with one delimiter; paths are as ``_metadata.file_path`` names them.

    Blank lines before the first record count as no record. One row a chunk is put in order for each file.
    """
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )
    chunks = stored(lines.mapInArrow(_gather(delimiter.encode(), chunk_bytes), _CHUNK_SQL), "csv-chunks")
    in_order = Window.partitionBy("path").orderBy("block", "chunk")
    before = F.coalesce(F.sum("swaps").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy("path")
    cases = (
        chunks.select("path", "block", "chunk", "swaps", "odd_outside", "odd_inside", "carriage", "bare")
        .withColumn("inside", before % 2 == 1)
        .withColumn("odd", F.when(F.col("inside"), F.col("odd_inside")).otherwise(F.col("odd_outside")) | F.col("bare"))
        .select(
            "path", "block", "chunk", "inside", (F.col("inside") != (F.col("swaps") == 1)).alias("ends_inside"),
            F.bool_or("odd").over(whole).alias("odd"), F.bool_or("carriage").over(whole).alias("carriage"),
        )
    )
    cases = stored(cases, "csv-cases")
    # File names only.
    odd = [row["path"] for row in cases.where("odd").select("path").distinct().collect()]
    # No hint: Spark broadcasts the narrow rows when their measured size allows it.
    known = chunks.select("path", "block", "chunk", "text").join(cases.where("not odd"), ["path", "block", "chunk"])
    columns = ["path", "block", "chunk", "text", "inside", "carriage"]
    found = known.select(*columns).mapInArrow(_cut, _PART_SQL).where(F.col("kind") == WHOLE)
    ends = known.where("inside or ends_inside").select(*columns).mapInArrow(_cut, _PART_SQL).where(F.col("kind") != WHOLE)
    # Ends follow each other as start, whole chunks, end; every start opens the next record.
    number = F.sum((F.col("kind") == START).cast("int")).over(in_order_of_ends())
    pieces = F.array_sort(F.collect_list(F.struct("block", "chunk", "kind", "record")))
    text = F.array_join(F.transform(pieces, lambda p: F.hex(p["record"])), "0A")
    spanning = ends.withColumn("number", number).groupBy("path", "number").agg(F.bool_or("first").alias("first"), F.unhex(text).alias("record"))
    table = found.select("path", "first", "record").unionByName(spanning.select("path", "first", "record"))
    return Records(table.where("not first").select("path", "record"), odd, [chunks, cases])


def in_order_of_ends():
    return Window.partitionBy("path").orderBy("block", "chunk", "kind")


def discard_records(spark: SparkSession, records: Records) -> None:
    discard(spark, *records.scratch)
