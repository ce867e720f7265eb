"""Years and months found in file names and month keys."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_PATTERN = r"((?:19|20)\d{2})"
PERIOD_PATTERN = r"(20\d{2})(\d{2})"


def file_period(name: Column) -> Column:
    """The first ``20YYMM`` in a file name, else an empty text."""
    return F.regexp_extract(name, PERIOD_PATTERN, 0)


def file_year(name: Column, period: Column | None = None) -> Column:
    """The year in a file name: the first ``20YYMM`` wins over the first plain year.

    ``period`` is the :func:`file_period` of the name, where a column holds it already.
    """
    period = file_period(name) if period is None else period
    # The plain year is looked for in names without a period only.
    plain = F.regexp_extract(name, YEAR_PATTERN, 1)
    return F.when(period != "", F.substring(period, 1, 4)).otherwise(F.when(plain != "", plain)).cast("int")


def file_month(name: Column, period: Column | None = None) -> Column:
    """The month of the first ``20YYMM`` in a file name, if it is one of 1 to 12."""
    period = file_period(name) if period is None else period
    number = F.when(period != "", F.substring(period, 5, 2)).cast("int")
    return F.when(number.between(1, 12), number)


def month_key(year: Column, month: Column) -> Column:
    """``2020M01``"""
    return F.format_string("%dM%02d", year, month)


def key_year(key: Column) -> Column:
    return F.substring(key, 1, 4).try_cast("int")


def key_month(key: Column) -> Column:
    return F.substring(key, -2, 2).try_cast("int")


def run_time() -> str:
    """The UTC time of a run as ISO text, taken once on the driver."""
    return datetime.now(timezone.utc).isoformat()
