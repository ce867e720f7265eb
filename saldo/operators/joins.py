"""Join shapes shared by several reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.functions.numbers import to_month


def full_years(df: DataFrame, month: str = "period_month", year: str = "year", last: int = 12) -> DataFrame:
    """Years whose greatest month reaches ``last``. Reads two columns."""
    months = df.filter(F.col(year).isNotNull()).groupBy(year).agg(F.max(to_month(F.col(month))).alias("_month"))
    return months.filter(F.col("_month") >= last).select(year)


def only_full_years(df: DataFrame, source: DataFrame, month: str = "period_month", year: str = "year") -> DataFrame:
    """Rows of ``df`` in the full years of ``source``; without a month column all rows stay.

    Call it on rows already aggregated to (group, year): the year is a key there, so the answer is
    the same, and the ledger rows themselves are never shuffled by year.
    """
    if month not in source.columns:
        return df.filter(F.col(year).isNotNull())
    return df.join(full_years(source, month, year), year, "left_semi")


def rows_for_keys(df: DataFrame, keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose key tuple is listed in ``keys``; a NULL in a key never matches.

    Hint ``keys`` with ``broadcast`` where its size has a bound, as a page of keys has.
    """
    return df.join(keys.select(*columns), list(columns), "left_semi")


def only_new(candidates: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Candidates whose key has not been seen."""
    return candidates.join(seen.select(key).distinct(), key, "left_anti")


def select_known(available: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """Available rows that were requested; their position column is kept."""
    return available.join(requested.select(key), key, "left_semi")


def attach_scalar(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Put the single value of a one-row, one-column frame on every row (a scalar subquery)."""
    return df.withColumn(name, one_row.scalar())
