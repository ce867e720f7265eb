"""Drill-down into one parent value, with optional child value and year."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.functions.numbers import measure as amount_of
from saldo.operators.filters import apply_filters
from saldo.operators.ordering import Page, Pager, page, spread_sort, top_by_abs


def yearly_sum(df: DataFrame, scope: Mapping[str, object], measure: str = "raun", scale: int = 2) -> DataFrame:
    """Sum of the measure per year; a year without a usable amount counts as 0."""
    rows = apply_filters(df, filters=scope).filter(F.col("year").isNotNull())
    total = F.coalesce(F.sum(amount_of(df, measure, scale)).cast("double"), F.lit(0.0))
    return rows.groupBy("year").agg(total.alias("actual_sum")).orderBy("year")


def breakdown(
    df: DataFrame,
    scope: Mapping[str, object],
    child: str,
    year: int | str | None = None,
    measure: str = "raun",
    k: int = 500,
    scale: int = 2,
) -> DataFrame:
    """Sum and row count by child value, largest absolute sum first."""
    rows = apply_filters(df, year, scope).filter(F.col(child).isNotNull())
    sums = rows.groupBy(F.col(child).alias("child_value")).agg(
        F.sum(amount_of(df, measure, scale)).cast("double").alias("actual_sum"),
        F.count(F.lit(1)).alias("row_count"),
    )
    return top_by_abs(sums, "actual_sum", k)


def _scope_rows(df: DataFrame, scope, columns: Sequence[str], year) -> DataFrame:
    present = [c for c in dict.fromkeys(columns) if c in df.columns]
    return apply_filters(df, year, scope).select(*present)


def records(
    df: DataFrame,
    scope: Mapping[str, object],
    columns: Sequence[str],
    year: int | str | None = None,
    number: int = 1,
    size: int = 100,
) -> Page:
    """One page of the rows in scope, latest year first."""
    return page(_scope_rows(df, scope, columns, year), ["-year"], number, size)


def record_pager(df: DataFrame, scope: Mapping[str, object], columns: Sequence[str], year: int | str | None = None) -> Pager:
    """The rows in scope for going through page by page."""
    return Pager(_scope_rows(df, scope, columns, year))


def export_scope(
    df: DataFrame, scope: Mapping[str, object], columns: Sequence[str], year: int | str | None = None
) -> DataFrame:
    """All rows in scope, latest year first (a range-partitioned sort, ready to be written)."""
    return spread_sort(_scope_rows(df, scope, columns, year), [F.desc_nulls_last("year")])


def scope_rows(
    df: DataFrame, scope: Mapping[str, object], columns: Sequence[str], year: int | str | None = None, k: int = 200
) -> DataFrame:
    """The first ``k`` rows in scope, latest year first; ``explore.count_rows`` has the total."""
    return export_scope(df, scope, columns, year).limit(k)
