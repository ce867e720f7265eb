"""Unusual year-on-year changes in deflated annual series, and browsing them.

Everything after :func:`annual_actuals` works on one row per (series, year). A series holds at
most one row per year, so its windows and nested lists stay short however large the ledger is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.functions.numbers import format_number, format_percent, format_score, to_year
from saldo.functions.numbers import measure as amount_of
from saldo.operators.filters import apply_filters, fill_keys, filter_anomalies
from saldo.operators.joins import attach_scalar, rows_for_keys
from saldo.operators.ordering import Page, distinct_keys, page, spread_sort
from saldo.operators.price_index import deflate
from saldo.settings import AnomalyConfig

SMALL = 1e-9
# Scales the median absolute deviation to the standard deviation of a normal distribution.
MAD_SCALE = 0.6745


def annual_actuals(df: DataFrame, keys: Sequence[str], measure: str = "raun", scale: int = 2) -> DataFrame:
    """Nominal sum per series and year; missing keys become ``(missing)``."""
    present = [k for k in keys if k in df.columns]
    rows = df.select(to_year(F.col("year")).alias("year"), *present, amount_of(df, measure, scale).alias("_amount"))
    rows = fill_keys(rows.dropna(subset=["year", "_amount"]), present)
    return rows.groupBy("year", *present).agg(F.sum("_amount").cast("double").alias("actual_nominal"))


def real_series(annual: DataFrame, index_annual: DataFrame) -> DataFrame:
    """Annual sums in prices of the latest index year."""
    return deflate(annual, index_annual).withColumn(
        "actual_real", F.col("actual_nominal") * F.col("deflator_to_latest")
    )


def with_prior(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The value of the series' previous present year; gaps are not filled."""
    in_order = Window.partitionBy(*keys).orderBy("year")
    return df.withColumn("prior_real", F.lag("actual_real").over(in_order))


def with_real_change(df: DataFrame) -> DataFrame:
    """Change and relative change; the latter over the absolute previous value."""
    change = F.col("actual_real") - F.col("prior_real")
    base = F.abs("prior_real")
    return df.withColumn("yoy_real_change", change).withColumn(
        "yoy_real_pct", F.when(base > SMALL, F.col("yoy_real_change") / base)
    )


def with_series_length(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("series_year_count", F.count("year").over(Window.partitionBy(*keys)))


def modified_zscore(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Robust z-score within a series; NULL when the median absolute deviation is 0 or missing."""
    series = Window.partitionBy(*keys)
    centred = df.withColumn("_off", F.col(value) - F.median(value).over(series))
    spread = centred.withColumn("_mad", F.median(F.abs("_off")).over(series))
    score = F.when(F.col("_mad") != 0, F.lit(MAD_SCALE) * F.col("_off") / F.col("_mad"))
    return spread.withColumn(name, score).drop("_off", "_mad")


def with_direction(df: DataFrame) -> DataFrame:
    """A missing change, as in the first year of a series, counts as a decrease."""
    grew = F.coalesce(F.col("yoy_real_change") >= 0, F.lit(False))
    return df.withColumn("direction", F.when(grew, "increase").otherwise("decrease"))


def with_score(df: DataFrame) -> DataFrame:
    sized = df.withColumns(
        {
            "abs_pct": F.abs("yoy_real_pct"),
            "abs_mz": F.abs("mz_yoy_pct"),
            "abs_change_real": F.abs("yoy_real_change"),
        }
    )
    score = F.coalesce("abs_mz", F.lit(0.0)) * 0.7 + F.coalesce("abs_pct", F.lit(0.0)) * 100 * 0.3
    return sized.withColumn("anomaly_score", score)


def is_anomaly(config: AnomalyConfig) -> Column:
    """All thresholds reached; a missing operand makes it false."""
    reached = (
        (F.col("series_year_count") >= config.min_years)
        & (F.col("abs_pct") >= config.pct_threshold)
        & (F.col("abs_mz") >= config.z_threshold)
        & (F.abs("prior_real") >= config.min_prior_real_abs)
        & (F.col("abs_change_real") >= config.min_abs_real_change)
    )
    return F.coalesce(reached, F.lit(False))


def score_series(series: DataFrame, keys: Sequence[str], config: AnomalyConfig) -> DataFrame:
    """Score real series; all windows share one shuffle and one sort on the series keys."""
    out = with_real_change(with_prior(series, keys))
    out = modified_zscore(with_series_length(out, keys), keys, "yoy_real_pct", "mz_yoy_pct")
    return with_score(with_direction(out)).withColumn("is_anomaly", is_anomaly(config))


def detect_anomalies(
    df: DataFrame,
    index_annual: DataFrame,
    keys: Sequence[str],
    config: AnomalyConfig = AnomalyConfig(),
    measure: str = "raun",
) -> DataFrame:
    """The whole chain from ledger rows to the scored table, one row per (series, year)."""
    present = [k for k in keys if k in df.columns]
    return score_series(real_series(annual_actuals(df, present, measure), index_annual), present, config)


def flagged(df: DataFrame) -> DataFrame:
    return rank_anomalies(df.filter("is_anomaly"))


def _ranking() -> list[Column]:
    return [F.desc_nulls_last("anomaly_score"), F.desc_nulls_last("abs_change_real")]


def rank_anomalies(df: DataFrame) -> DataFrame:
    return spread_sort(df, _ranking())


def export_anomalies(df: DataFrame, parents: Sequence[str], **wanted) -> DataFrame:
    """All columns of the flagged rows that pass ``filter_anomalies``, highest score first."""
    return rank_anomalies(filter_anomalies(df, parents, **wanted))


def anomaly_page(df: DataFrame, columns: Sequence[str], number: int = 1, size: int = 100) -> Page:
    """One page of the flagged table, highest score first."""
    fixed = [
        "year", "direction", "anomaly_score", "yoy_real_pct", "yoy_real_change",
        "actual_real", "prior_real", "abs_change_real",
    ]
    rows = df.select(*fixed, *[c for c in columns if c not in fixed])
    return page(rows, ["-anomaly_score", "-abs_change_real"], number, size)


def anomaly_yearly(df: DataFrame, parent: str | None = None, value: str = "all") -> DataFrame:
    """Count and size of the anomalies per year, increases and decreases apart."""
    rows = df if parent is None or value == "all" else apply_filters(df, filters={parent: value})
    change, size = F.col("yoy_real_change"), F.abs("yoy_real_change")
    return (
        rows.groupBy("year")
        .agg(
            F.count(F.lit(1)).alias("anomalies_count"),
            F.coalesce(F.sum("abs_change_real"), F.lit(0.0)).alias("abs_change_sum"),
            F.sum(F.when(change > 0, size).otherwise(0.0)).alias("abs_change_increase"),
            F.sum(F.when(change < 0, size).otherwise(0.0)).alias("abs_change_decrease"),
        )
        .orderBy("year")
    )


def series_totals(all_rows: DataFrame, keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Real sum per year of the listed series."""
    rows = rows_for_keys(all_rows, keys, columns)
    return rows.groupBy("year", *columns).agg(F.sum("actual_real").alias("actual_real_sum"))


def nested_totals(totals: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The totals of a series as one list ordered by year; one entry per year at most."""
    entry = F.struct(
        F.col("year"),
        F.coalesce("actual_real_sum", F.lit(0.0)).alias("actual_real"),
        format_number(F.col("actual_real_sum")).alias("actual_real_fmt"),
    )
    return totals.groupBy(*columns).agg(F.array_sort(F.collect_list(entry)).alias("year_totals"))


def attach_series_totals(shown: Page, all_rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row of a page with the year list of its series; none gives an empty list.

    A page is at most 500 rows, so its keys and their lists are small enough to broadcast.
    """
    keys = distinct_keys(shown.rows, columns)
    nested = nested_totals(series_totals(all_rows, F.broadcast(keys), columns), columns)
    joined = shown.rows.join(F.broadcast(nested), list(columns), "left")
    empty = F.array().cast(nested.schema["year_totals"].dataType)
    return joined.withColumn("year_totals", F.coalesce("year_totals", empty))


def with_display(df: DataFrame) -> DataFrame:
    """Score, percentage and amounts as shown on the page."""
    return df.withColumns(
        {
            "anomaly_score_fmt": format_score(F.col("anomaly_score")),
            "yoy_real_pct_fmt": format_percent(F.coalesce("yoy_real_pct", F.lit(0.0)) * 100),
            "yoy_real_change_fmt": format_number(F.col("yoy_real_change")),
            "actual_real_fmt": format_number(F.col("actual_real")),
            "prior_real_fmt": format_number(F.col("prior_real")),
        }
    )


def anomaly_summary(all_rows: DataFrame, index_annual: DataFrame, config: AnomalyConfig) -> DataFrame:
    """One row: table sizes, the years the index covers, and the thresholds."""
    span = index_annual.agg(F.struct(F.min("year").alias("first"), F.max("year").alias("last")))
    counts = all_rows.agg(F.count(F.lit(1)).alias("rows_total"), F.count_if("is_anomaly").alias("rows_flagged"))
    covered = attach_scalar(counts, span, "_span")
    return covered.withColumns(
        {
            "year_from": F.col("_span.first"),
            "year_to": F.col("_span.last"),
            "z_threshold": F.lit(float(config.z_threshold)),
            "pct_threshold": F.lit(float(config.pct_threshold)),
            "min_abs_real_change": F.lit(float(config.min_abs_real_change)),
            "min_prior_real_abs": F.lit(float(config.min_prior_real_abs)),
        }
    ).drop("_span")
