"""Faceted exploration: sums, totals, value counts, facet options and a preview."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.functions.numbers import measure as amount_of
from saldo.operators.filters import apply_filters, year_value
from saldo.operators.ordering import clamp, tie_break, top_k


def summary_by(
    df: DataFrame,
    category: str,
    measure: str = "raun",
    filters: Mapping[str, object] | None = None,
    year: int | str | None = None,
    k: int = 50,
    scale: int = 2,
) -> DataFrame:
    """Sum of the measure by category, largest first; a NULL category is a group of its own."""
    rows = apply_filters(df, year, filters)
    sums = rows.groupBy(category).agg(F.sum(amount_of(df, measure, scale)).cast("double").alias(measure))
    return top_k(sums, [F.desc_nulls_last(measure)], k)


def totals(
    df: DataFrame,
    measure: str = "raun",
    filters: Mapping[str, object] | None = None,
    year: int | str | None = None,
    scale: int = 2,
) -> DataFrame:
    """One row: number of rows, sum, sum of the positive and of the negative amounts."""
    amount = amount_of(df, measure, scale)

    def total(value: Column, name: str) -> Column:
        return F.coalesce(F.sum(value).cast("double"), F.lit(0.0)).alias(name)

    return apply_filters(df, year, filters).agg(
        F.count(F.lit(1)).alias("rows"),
        total(amount, "sum"),
        total(F.when(amount > 0, amount), "sum_pos"),
        total(F.when(amount < 0, amount), "sum_neg"),
    )


def value_counts(
    df: DataFrame,
    category: str,
    filters: Mapping[str, object] | None = None,
    year: int | str | None = None,
    k: int = 50,
) -> DataFrame:
    counts = apply_filters(df, year, filters).groupBy(category).agg(F.count(F.lit(1)).alias("count"))
    return top_k(counts, [F.desc("count")], k)


def count_rows(
    df: DataFrame, filters: Mapping[str, object] | None = None, year: int | str | None = None
) -> DataFrame:
    return apply_filters(df, year, filters).agg(F.count(F.lit(1)).alias("rows"))


def _long(df: DataFrame, value: Mapping[str, Column], name: str) -> DataFrame:
    """One row per (column name, value), NULL values dropped."""
    texts = df.select(*[v.cast("string").alias(c) for c, v in value.items()])
    return texts.unpivot([], list(value), name, "value").filter(F.col("value").isNotNull())


#: A column is sure to have too many values when its sketch says so many times the bound.
SKETCH_MARGIN = 1.25


def narrow_columns(df: DataFrame, columns: Sequence[str], most: int) -> list[str]:
    """The columns that may have at most ``most`` values, by sketches of a few kilobytes a column and task."""
    if not columns:
        return []
    estimates = [F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"))).alias(c) for c in columns]
    found = df.agg(*estimates).first()
    return [c for c in columns if found[c] is not None and found[c] <= most * SKETCH_MARGIN]


def category_profile(df: DataFrame, columns: Sequence[str], most: int = 200) -> DataFrame:
    """Distinct count of each candidate column, kept when it is above 1 and at most ``most``.

    Wide columns are left out by their sketches first, so of a column of a billion values only sketches move. The others
    are counted exactly in one scan; each task reduces to distinct values before the shuffle.
    """
    present = narrow_columns(df, [c for c in dict.fromkeys(columns) if c in df.columns], most)
    if not present:
        return df.sparkSession.createDataFrame([], "category string, distinct_count bigint")
    pairs = _long(df, {c: F.col(c) for c in present}, "category").distinct()
    counts = pairs.groupBy("category").agg(F.count(F.lit(1)).alias("distinct_count"))
    return counts.filter((F.col("distinct_count") > 1) & (F.col("distinct_count") <= most)).orderBy("category")


def facet_options(
    df: DataFrame,
    columns: Sequence[str],
    filters: Mapping[str, object] | None = None,
    year: int | str | None = None,
    most: int = 200,
) -> DataFrame:
    """The values each column offers under the filters on all other columns.

    One scan serves every column: a row counts for all columns when no filter fails, and for
    column ``c`` alone when the filter on ``c`` is the only one that fails. The cap per column is
    applied inside each task as well as after the shuffle, so no task sees a whole column.
    """
    filters = dict(filters or {})
    present = [c for c in columns if c in df.columns]
    fails = {c: F.when(F.col(c) == v, 0).otherwise(1) for c, v in filters.items()}
    scope = apply_filters(df, year_value(year))
    if fails:
        scope = scope.withColumn("_fails", reduce(lambda a, b: a + b, fails.values())).filter(F.col("_fails") <= 1)
    value = {}
    for c in present:
        if not fails:
            value[c] = F.col(c)
        elif c in fails:
            value[c] = F.when((F.col("_fails") == 0) | (fails[c] == 1), F.col(c))
        else:
            value[c] = F.when(F.col("_fails") == 0, F.col(c))
    options = _long(scope, value, "facet").distinct()
    rank = F.row_number().over(Window.partitionBy("facet").orderBy("value"))
    return options.withColumn("position", rank).filter(F.col("position") <= most)


def preview(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    filters: Mapping[str, object] | None = None,
    year: int | str | None = None,
    limit: int = 50,
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """The first rows (1 to 500). Without ``order`` the scan stops as soon as it has enough."""
    rows = apply_filters(df, year, filters)
    rows = rows.select(*columns) if columns else rows
    if order is not None:
        rows = rows.orderBy(*tie_break(rows, order))
    return rows.limit(clamp(limit, 1, 500))
