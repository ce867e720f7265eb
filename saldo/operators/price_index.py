"""Price index: reply parsing, annual means, and deflation to the latest year."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.functions.numbers import parse_number, to_year
from saldo.functions.periods import key_month, key_year, month_key
from saldo.operators.joins import attach_scalar

REPLY_SCHEMA = "data array<struct<key: array<string>, values: array<string>>>"
# Digits of an index value, six of them after the comma.
INDEX_PRECISION = 28
MONTH_KEY = r"^\d{4}.*\d{2}$"


def year_range(df: DataFrame, year: str = "year") -> DataFrame:
    """First and last year as one row; reads one column."""
    value = to_year(F.col(year))
    return df.agg(F.min(value).alias("year_min"), F.max(value).alias("year_max"))


def requested_months(df: DataFrame, as_of_year: int | None = None) -> DataFrame:
    """Every month from the first data year to the later of last data year and ``as_of_year``."""
    as_of = date.today().year if as_of_year is None else as_of_year
    span = year_range(df).select("year_min", F.greatest("year_max", F.lit(as_of)).alias("year_end"))
    return expand_months(span, F.col("year_min"), F.col("year_end"))


def expand_months(df: DataFrame, first: Column, last: Column) -> DataFrame:
    years = df.select(F.explode(F.sequence(first, last)).alias("year"))
    months = years.select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return months.select(month_key(F.col("year"), F.col("month")).alias("month_key"), "year", "month")


def month_keys(spark: SparkSession, first: int, last: int) -> DataFrame:
    """``2020M01`` and so on for the years ``first`` to ``last``."""
    return expand_months(spark.range(1), F.lit(first), F.lit(last))


def parse_index_json(df: DataFrame, body: str = "body") -> DataFrame:
    """Index replies as rows: first key, first value; rows without a usable value are dropped.

    A value with a key that names no month is an error, as is a value too wide for its decimal.
    """
    reply = F.from_json(F.col(body), REPLY_SCHEMA)
    items = df.select(F.explode(reply["data"]).alias("item"))
    cells = items.select(
        F.get(F.col("item.key"), 0).alias("month_key"),
        parse_number(F.get(F.col("item.values"), 0), scale=6, precision=INDEX_PRECISION).cast("double").alias("cpi"),
    )
    usable = cells.filter(F.col("month_key").isNotNull() & F.col("cpi").isNotNull())
    wrong = F.raise_error(F.concat(F.lit("no month key: "), F.col("month_key"))).cast("string")
    key = F.when(F.col("month_key").rlike(MONTH_KEY), F.col("month_key")).otherwise(wrong)
    keyed = usable.select(key.alias("month_key"), "cpi")
    rows = keyed.select(
        key_year(F.col("month_key")).alias("year"), key_month(F.col("month_key")).alias("month"), "month_key", "cpi"
    )
    return rows.orderBy("year", "month")


def annual_index(monthly: DataFrame) -> DataFrame:
    """Mean index per year, the mean of the latest year, and the factor that lifts to it.

    A month key starts with four digits, so there are at most ten thousand rows.
    """
    annual = monthly.groupBy("year").agg(F.avg("cpi").alias("cpi_avg"))
    latest = annual.agg(F.max_by("cpi_avg", "year"))
    based = attach_scalar(annual, latest, "cpi_latest_base")
    return based.withColumn("deflator_to_latest", F.try_divide("cpi_latest_base", "cpi_avg"))


def deflate(facts: DataFrame, annual: DataFrame) -> DataFrame:
    """Facts with the factor of their year; years without one are dropped.

    No hint: Spark broadcasts the annual table when its measured size allows it.
    """
    factors = annual.select("year", "deflator_to_latest").filter(F.col("deflator_to_latest").isNotNull())
    return facts.join(factors, "year", "inner")
