"""Best-fit packing with certified bin counts.

Documents become pieces of one capacity at most. Pieces are dealt at random, by their row number, into groups of
bounded size, and each group is packed by best-fit decreasing. Dual feasible functions give a lower bound of each
group's bins: a group that meets its bound is certified and keeps its bins. The groups with a gap give up
their loosest bins, as every group does with its last open ones; the documents of those are mixed, dealt
out again and packed anew, and the new packing stays where it needs fewer bins than the old one.

Cases: a null or empty text is the end id alone; a null id is a row like any other; repeated rows are packed
each; a text of any length is cut into whole pieces of the capacity behind a shorter first one; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.llm.encoder import library_encoder
from saldo.sources.scratch import stored

CAPACITY = 1024
END_ID = 2
#: Pieces that one task packs together, on average.
GROUP_ROWS = 50_000
#: Times that open bins are mixed and packed again.
ROUNDS = 3

_PIECE = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64())]
    + [("length", pa.int64()), ("ids_crc32", pa.int64())]
)
_PIECE_SQL = "row bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32): the pieces of every document's ids and their end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer, spaced=True)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for ids, counts in encoder.batches(t.as_py() for t in batch.column(1)):
                out: list[tuple] = []
                ends = np.cumsum(counts)
                for name, begin, end in zip(names[at : at + len(counts)], ends - counts, ends, strict=True):
                    whole = np.append(ids[begin:end], end_id).astype("<u4")
                    first = len(whole) % capacity or capacity
                    starts = [0, *range(first, len(whole), capacity)]
                    for piece, (start, stop) in enumerate(zip(starts, [*starts[1:], len(whole)], strict=True)):
                        out.append((row, name, piece, start, stop - start, zlib.crc32(whole[start:stop].tobytes())))
                        row += 1
                at += len(counts)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PIECE, strict=True)], schema=_PIECE)

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, _PIECE_SQL)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """The bin of each item, and the room that is left in each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    # Bit r is set while some bin has room r, so the tightest bin is the lowest bit from the length on.
    mask = 0
    for at, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            chosen = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
        else:
            r, chosen = capacity, len(room)
            room.append(capacity)
        left = r - size
        room[chosen] = left
        if left:
            by_room[left].append(chosen)
            mask |= 1 << left
        bins[at] = chosen
    return bins, room


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound of two families of dual feasible functions, in whole numbers."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * sizes).sum()) // capacity)
    # Items above capacity - e count as whole bins, items below e as nothing.
    count_from, room_from = np.cumsum(counts[::-1])[::-1], np.cumsum((counts * sizes)[::-1])[::-1]
    for e in range(1, capacity // 2 + 1):
        large, middle = int(count_from[capacity - e + 1]), int(room_from[e] - room_from[capacity - e + 1])
        best = max(best, large - (-middle // capacity))
    # Sizes are rounded down to k-ths of a bin, those that are whole (k + 1)-ths stay.
    for k in range(1, 33):
        scaled = sizes * (k + 1)
        values = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * values).sum()) // (capacity * k)))
    return best


_PLACED = pa.schema([("row", pa.int64()), ("length", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loose", pa.bool_())])
_PLACED_SQL = "row bigint, length bigint, sequence_id bigint, offset bigint, loose boolean"


def _pack_group(number: int, capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        rows, lengths = (table.column(c).to_numpy() for c in ("row", "length"))
        bins, room = best_fit_decreasing(lengths, capacity)
        gap = len(room) - lower_bound(lengths, capacity)
        # The loosest bins: the last open one at least, and for each bin above the bound enough to refill it.
        room = np.array(room)
        order = np.argsort(-room, kind="stable")
        give = np.zeros(len(room), bool)
        give[order[: 1 + 8 * gap]] = True
        give &= room > 0
        at = np.lexsort((rows, bins))
        ends = np.cumsum(lengths[at])
        firsts = np.concatenate([[True], bins[at][1:] != bins[at][:-1]])
        base = np.maximum.accumulate(np.where(firsts, ends - lengths[at], 0))
        ids = (np.int64(number) << 56) + (np.int64(key[0].as_py()) << 24) + bins[at]
        return pa.table([rows[at], lengths[at], ids, ends - lengths[at] - base, give[bins[at]]], schema=_PLACED)

    return run


def _packed(items: DataFrame, number: int, capacity: int, group_rows: int) -> DataFrame:
    groups = -(-items.count() // group_rows) or 1
    key = F.pmod(F.xxhash64("row", F.lit(number)), F.lit(groups)).alias("group")
    return items.select("row", "length", key).groupBy("group").applyInArrow(_pack_group(number, capacity), _PLACED_SQL)


def pack(parts: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """(row, sequence_id, offset) for items (row, length); rows are distinct, lengths 1 to the capacity."""
    placed = stored(_packed(parts, 0, capacity, group_rows), "packed")
    final = placed
    for number in range(1, rounds + 1):
        pool = final.where("loose")
        before = pool.select("sequence_id").distinct().count()
        if before < 2:
            break
        again = stored(_packed(pool, number, capacity, group_rows), "packed")
        if again.select("sequence_id").distinct().count() >= before:
            break
        final = final.where("not loose").unionByName(again)
    return final.select("row", "sequence_id", "offset")


def packed_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    group_rows: int = GROUP_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    parts = stored(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    return parts.join(pack(parts, capacity, group_rows), "row").drop("row")
