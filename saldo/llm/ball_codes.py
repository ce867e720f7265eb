"""Vector codes by ball k-means over parts of the vectors, in whole numbers.

Components become integers, vectors are cut into parts, and each part position has a codebook of ``ENTRIES`` entries that
starts as that part of the smallest ids. A round assigns every part to the nearest entry, ties to the lower index, and
then moves every entry to the floored mean of its parts.

After the first round a part knows the entry it belongs to, and the parts of an entry form a ball around it. With e the squared
distance to the own entry and D that from the own entry to another one, the other can only win or tie if D <= 4e. So a part
whose 4e lies below the least D of its entry is in the stable core and is done with one distance. The largest e of a batch is the
squared radius of its ball and bounds the entries that count as neighbours; the other parts lie in rings between the neighbours'
D, and a part is compared with the neighbours up to its ring only. All figures are integers, so the result is that of a
full search. Radii are taken for each batch by itself: the balls are smaller, and no pass over all rows is needed for them.

Rows are read once; their integers and codes are written after each round and read by the next, and the table before is
deleted. The driver holds the codebooks alone: parts x entries x components.

Cases: rows whose vector is null, empty, or holds null or non-finite components are dropped, and so are vectors of another
length than most (of equally frequent lengths the smaller counts). A length that the parts do not divide gives the
first parts one component more. With fewer rows than entries there are as many entries as rows. Null ids are kept and come
last in the order of ids; rows that repeat an id count each, ordered by their vectors. Integers beyond ``LARGEST`` in size count as
it, so that errors fit a long; a label's sum beyond a long is null. An empty table gives an empty result. Columns other than id,
vector and label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.sources.scratch import discard, stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
LARGEST = 1 << 27
#: Pairs of a part and an entry that a task compares at once.
PAIRS = 1 << 20


@dataclass(frozen=True)
class Codebooks:
    """Entries of each part position: arrays of entries by components."""

    parts: list[np.ndarray]

    def split(self, rows: np.ndarray) -> list[np.ndarray]:
        return np.split(rows, np.cumsum([p.shape[1] for p in self.parts])[:-1], axis=1)

    def sha256(self) -> str:
        numbers = ",".join(str(x) for part in self.parts for entry in part for x in entry)
        return hashlib.sha256(numbers.encode()).hexdigest()


def part_widths(width: int, parts: int) -> list[int]:
    return [width // parts + (i < width % parts) for i in range(parts)]


def full_search(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of every part, for parts that belong to none yet."""
    out = np.empty(len(rows), np.int64)
    step = max(1, PAIRS // max(1, len(entries)))
    for at in range(0, len(rows), step):
        gap = rows[at : at + step, None, :] - entries[None, :, :]
        out[at : at + step] = np.einsum("nkd,nkd->nk", gap, gap).argmin(axis=1)
    return out


def ball_search(rows: np.ndarray, entries: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every part and its squared distance, from the entry it belonged to."""
    between = entries[:, None, :] - entries[None, :, :]
    between = np.einsum("ijd,ijd->ij", between, between)
    np.fill_diagonal(between, -1)
    # Neighbours of each entry by distance, itself left out.
    near = np.argsort(between, axis=1, kind="stable")[:, 1:]
    away = np.take_along_axis(between, near, axis=1)
    gap = rows - entries[own]
    error = np.einsum("nd,nd->n", gap, gap)
    best = own.copy()
    if not near.shape[1]:
        return best, error
    outside = np.flatnonzero(4 * error >= away[own, 0])
    if not len(outside):
        return best, error
    radius = np.zeros(len(entries), np.int64)
    np.maximum.at(radius, own[outside], error[outside])
    neighbours = (away <= 4 * radius[:, None]).sum(axis=1).max()
    ring = (away[own[outside], :neighbours] <= 4 * error[outside, None]).sum(axis=1)
    ends = np.cumsum(ring)
    first = 0
    while first < len(outside):
        # At least one part, and as many as their pairs allow.
        stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
        part, count = outside[first:stop], ring[first:stop]
        starts = np.cumsum(count) - count
        member = np.repeat(part, count)
        rival = near[own[member], np.arange(len(member)) - np.repeat(starts, count)]
        gap = rows[member] - entries[rival]
        gap = np.einsum("nd,nd->n", gap, gap)
        least = np.minimum.reduceat(gap, starts)
        # The lowest index among the nearest rivals.
        lowest = np.minimum.reduceat(np.where(gap == np.repeat(least, count), rival, len(entries)), starts)
        wins = (least < error[part]) | ((least == error[part]) & (lowest < own[part]))
        best[part[wins]], error[part[wins]] = lowest[wins], least[wins]
        first = stop
    return best, error


def _integers(column: pa.Array) -> np.ndarray:
    """Rows of little-endian integers of four bytes, as written by :func:`_to_integers`."""
    width = len(column[0].as_py()) // 4 if len(column) else 0
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), width).astype(np.int64)


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts).astype(np.int64)


_ROW = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("numbers", pa.binary()), ("code", pa.binary())])
_ROW_SQL = "vec_id bigint, label string, numbers binary, code binary"


def _to_integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b for b in batches if b.num_rows):
        vectors = batch.column(2)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
        numbers = np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype("<i4")
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([row.tobytes() for row in numbers], pa.binary()), pa.nulls(len(batch), pa.binary())], schema=_ROW)


def _packed(codes: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in codes.astype(np.uint8)], pa.binary())


def _assigned(books: Codebooks, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Codes and errors of a batch's rows; a row without a code is searched in full."""
    rows = books.split(_integers(batch.column(2)))
    codes, errors = np.zeros((len(batch), len(rows)), np.int64), np.zeros(len(batch), np.int64)
    fresh = batch.column(3).null_count > 0
    known = None if fresh else _codes(batch.column(3), len(rows))
    for i, (part, entries) in enumerate(zip(rows, books.parts, strict=True)):
        own = full_search(part, entries) if fresh else known[:, i]
        if fresh:
            gap = part - entries[own]
            codes[:, i], error = own, np.einsum("nd,nd->n", gap, gap)
        else:
            codes[:, i], error = ball_search(part, entries, own)
        errors += error
    return codes, errors


def _assign(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, _ = _assigned(books, batch)
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), _packed(codes)], schema=_ROW)

    return run


_SUM = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def _sum_entries(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Number and sum of the parts of each entry, over all that a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros_like(p) for p in books.parts]
        counts = [np.zeros(len(p), np.int64) for p in books.parts]
        for batch in batches:
            codes = _codes(batch.column(3), len(sums))
            for i, part in enumerate(books.split(_integers(batch.column(2)))):
                np.add.at(sums[i], codes[:, i], part)
                counts[i] += np.bincount(codes[:, i], minlength=len(counts[i]))
        used = [(i, j) for i, n in enumerate(counts) for j in np.flatnonzero(n)]
        columns = [[i for i, _ in used], [j for _, j in used], [counts[i][j] for i, j in used], [sums[i][j].tolist() for i, j in used]]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SUM, strict=True)], schema=_SUM)

    return run


def moved(books: Codebooks, rows: DataFrame) -> Codebooks:
    """Every entry at the floored mean of its parts; entries without parts stay."""
    width = max(p.shape[1] for p in books.parts)
    sums = rows.mapInArrow(_sum_entries(books), "part int, entry int, n bigint, sums array<bigint>")
    places = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
    out = [p.copy() for p in books.parts]
    # One row an entry.
    for row in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *places).collect():
        part = out[row["part"]]
        part[row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(part.shape[1])]
    return Codebooks(out)


def _coded(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = _assigned(books, batch)
            texts = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(errors)], schema=schema)

    return run


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    plain = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector"))
    infinite = F.lit(float("inf"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != infinite))
    kept = plain.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & sound)
    # One row for each length.
    lengths = kept.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    return kept.where(F.size("vector") == (lengths[0]["width"] if lengths else 0))


def encode(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, Codebooks | None]:
    """``vec_id, label, code, error`` of every row that takes part, and the codebooks (None without rows)."""
    if entries > 256:
        raise ValueError("a code of two hex digits names at most 256 entries")
    spark = rows.sparkSession
    vectors = usable(rows, id_col, vector_col, label_col)
    numbers = vectors.select("vec_id", "label", "vector").mapInArrow(_to_integers, _ROW_SQL)
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    if not first:
        return spark.createDataFrame([], "vec_id bigint, label string, code string, error bigint"), None
    start = np.clip(np.floor(SCALE * np.array([r["vector"] for r in first])), -LARGEST, LARGEST).astype(np.int64)
    ends = np.cumsum(part_widths(start.shape[1], parts))[:-1]
    books = Codebooks(np.split(start, ends, axis=1))
    held = None
    for _ in range(rounds):
        table = stored((held if held is not None else numbers).mapInArrow(_assign(books), _ROW_SQL), "coded-vectors")
        if held is not None:
            discard(spark, held)
        held, books = table, moved(books, table)
    coded = stored((held if held is not None else numbers).mapInArrow(_coded(books), "vec_id bigint, label string, code string, error bigint"), "vector-codes")
    if held is not None:
        discard(spark, held)
    return coded, books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """The sum of errors over the rows of the same label beside each row; rows without label are one group.

    Sums are formed in the tasks first; one row a label is joined, which Spark broadcasts if its size allows and
    whose crowded keys it splits otherwise.
    """
    key = [F.coalesce("label", F.lit("")).alias("name"), F.col("label").isNull().alias("absent")]
    sums = coded.groupBy(*key).agg(F.try_sum("error").alias("label_error"))
    return coded.select("*", *key).join(sums, ["name", "absent"]).drop("name", "absent")
