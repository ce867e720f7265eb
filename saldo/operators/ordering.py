"""Sorts, limits, pages and duplicates. Every limit has a unique order, so results repeat."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saldo.sources.scratch import discard, scratch_dir, stored

PAGE_SIZES = (25, 500)


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def tie_break(df: DataFrame, order: Sequence[Column]) -> list[Column]:
    """The wanted order followed by all columns, so equal sort keys still have one order."""
    return [*order, *[F.asc_nulls_last(c) for c in df.columns]]


def spread_sort(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Sort by the wanted order and then all columns, into parts of even size.

    Rows that are equal in every column have their number as a last key, so a run of them is split between parts.
    """
    number = "row_number"
    while number in df.columns:
        number += "_"
    numbered = df.withColumn(number, F.monotonically_increasing_id())
    return numbered.orderBy(*tie_break(df, order), number).drop(number)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows; a sort and limit that each task applies before anything moves."""
    return df.orderBy(*tie_break(df, order)).limit(k)


def top_by(df: DataFrame, column: str, k: int) -> DataFrame:
    return top_k(df, [F.desc_nulls_last(column)], k)


def top_by_abs(df: DataFrame, column: str, k: int) -> DataFrame:
    return top_k(df, [F.desc_nulls_last(F.abs(column))], k)


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    number: int
    pages: int
    total: int


def _sort(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Sort by names (``-name`` for descending) and then by all columns; NULLs come last."""
    return spread_sort(df, [F.desc_nulls_last(n[1:]) if n.startswith("-") else F.asc_nulls_last(n) for n in order])


@dataclass(frozen=True)
class PageIndex:
    """The rows of a frame sorted once and stored in parts, with the number of rows of each part.

    A part lies in a folder of its own, and its rows carry their place: the upper bits number the part and the lower 33
    bits the row in it, as the places grow with the order. A page is a range of places in one or a few parts.
    """

    parts: DataFrame
    counts: tuple[tuple[int, int], ...]

    @property
    def total(self) -> int:
        return sum(rows for _, rows in self.counts)

    def page(self, number: int = 1, size: int = 100) -> Page:
        """A page by its number; one beyond the end is the last. Nothing but its own rows is sorted."""
        size = clamp(size, *PAGE_SIZES)
        pages = max(1, -(-self.total // size))
        number = clamp(number, 1, pages)
        first, before, ends = (number - 1) * size, 0, []
        stop = min(first + size, self.total)
        for part, rows in self.counts:
            low, high = max(first - before, 0), min(stop - before, rows)
            if low < high:
                ends.append((part, low, high - 1))
            before += rows
        if not ends:
            return Page(self.parts.limit(0).select("row.*"), number, pages, self.total)
        (one, low, _), (other, _, high) = ends[0], ends[-1]
        held = self.parts.where(F.col("part").between(one, other) & F.col("place").between((one << 33) + low, (other << 33) + high))
        return Page(held.coalesce(1).sortWithinPartitions("place").select("row.*"), number, pages, self.total)

    def discard(self) -> None:
        """Delete the parts; pages taken from them can no longer be read."""
        discard(self.parts.sparkSession, self.parts)


def page_index(df: DataFrame, order: Sequence[str]) -> PageIndex:
    """Sort a frame by names (``-name`` for descending) into stored parts, which any page is then read from.

    The rows are stored before the sort, which reads them twice. No task holds more than its part.
    """
    spark = df.sparkSession
    rows = stored(df, "page-rows")
    place = F.monotonically_increasing_id()
    placed = _sort(rows, order).select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), place.alias("place"))
    path = f"{scratch_dir(spark, 'page-parts')}/table"
    placed.withColumn("part", F.shiftright("place", 33)).write.partitionBy("part").parquet(path)
    discard(spark, rows)
    schema = T.StructType([*placed.schema.fields, T.StructField("part", T.LongType())])
    parts = spark.read.schema(schema).parquet(path)
    # One row for each partition of the sort.
    counts = parts.groupBy("part").count().orderBy("part").collect()
    return PageIndex(parts, tuple((row["part"], row["count"]) for row in counts))


class Pager:
    """Pages of one frame in any order; an order is sorted when it is first asked for and kept until the frame changes."""

    def __init__(self, df: DataFrame):
        self._df = df
        self._indexes: dict[tuple[str, ...], PageIndex] = {}

    def page(self, order: Sequence[str], number: int = 1, size: int = 100) -> Page:
        key = tuple(order)
        if key not in self._indexes:
            self._indexes[key] = page_index(self._df, order)
        return self._indexes[key].page(number, size)

    def replace(self, df: DataFrame) -> None:
        """Go on with another frame; the parts of the one before are deleted."""
        self.close()
        self._df = df

    def close(self) -> None:
        while self._indexes:
            self._indexes.popitem()[1].discard()


def page(df: DataFrame, order: Sequence[str], number: int = 1, size: int = 100) -> Page:
    """One page of ``df``, sorted by names (``-name`` for descending). Use a :class:`Pager` where more pages follow."""
    return page_index(df, order).page(number, size)


def distinct_values(df: DataFrame, column: str, cap: int) -> DataFrame:
    """Distinct non-null values in ascending order, at most ``cap``."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(cap)


def distinct_years(df: DataFrame, year: str = "year") -> DataFrame:
    return df.select(year).filter(F.col(year).isNotNull()).distinct().orderBy(year)


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).dropDuplicates()


def first_seen(df: DataFrame, column: str, position: str) -> DataFrame:
    """One row per value with its smallest position; combines before the shuffle."""
    return df.groupBy(column).agg(F.min(position).alias(position))


def mixed_order(column: str, descending: bool = False) -> list[Column]:
    """Order for cells that hold numbers or words: numbers by size, then words without case.

    A number may carry grouping dots, a decimal comma and one percent sign.
    """
    text = F.trim(F.col(column).cast("string"))
    bare = F.trim(F.regexp_replace(F.translate(text, ".", ""), "^([^%]*)%", "$1"))
    is_number = bare.rlike(r"^[+-]?([0-9]+,?[0-9]*|,[0-9]+)([eE][+-]?[0-9]+)?$")
    number = F.when(is_number, F.translate(bare, ",", ".").try_cast("double"))
    turn = F.desc_nulls_last if descending else F.asc_nulls_last
    return [number.isNull().asc(), turn(number), turn(F.lower(text)), F.asc_nulls_last(text)]


def mixed_sort(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    return df.orderBy(*mixed_order(column, descending))
