"""Row filters and the derived department columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions.text import clean, key_text, map_values
from saldo.settings import DEPARTMENT_MODES, LedgerProfile

ALL = "all"


def year_value(year: int | str | None) -> int | None:
    """The year to filter on; ``all``, empty and unusable values mean no filter."""
    if year is None or year == ALL:
        return None
    try:
        return int(year)
    except ValueError:
        return None


def _equal(filters: Mapping[str, object], exclude: str | None = None) -> list[Column]:
    return [F.col(c) == v for c, v in filters.items() if c != exclude]


def apply_filters(
    df: DataFrame,
    year: int | str | None = None,
    filters: Mapping[str, object] | None = None,
    exclude: str | None = None,
    year_column: str = "year",
) -> DataFrame:
    """Keep rows equal to every filter value, except the filter on ``exclude``."""
    tests = _equal(filters or {}, exclude)
    wanted = year_value(year)
    if wanted is not None:
        tests.insert(0, F.col(year_column) == wanted)
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def exclude_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Drop the listed values and, as SQL ``NOT IN`` does, NULL as well."""
    kept = df.filter(F.col(column).isNotNull())
    return kept.filter(~F.col(column).isin(list(values))) if values else kept


def differs(column: str, value: object) -> Column:
    """True when the value differs or is NULL."""
    return ~F.col(column).eqNullSafe(F.lit(value))


def with_departments(df: DataFrame, profile: LedgerProfile) -> DataFrame:
    """Add the raw, canonical and family department; the source column must exist."""
    source = F.col(profile.department_source)
    return df.withColumns(
        {
            DEPARTMENT_MODES["raw"]: clean(source),
            DEPARTMENT_MODES["canonical"]: map_values(source, profile.canonical),
            DEPARTMENT_MODES["family"]: map_values(source, profile.family),
        }
    )


def fill_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Series keys as text with ``(missing)`` in place of NULL."""
    return df.withColumns({k: key_text(F.col(k)) for k in keys})


def filter_anomalies(
    df: DataFrame,
    parents: Sequence[str],
    year: int | str | None = ALL,
    direction: str = ALL,
    parent: str = "tegund0",
    value: str = ALL,
) -> DataFrame:
    """Rows of the anomaly table by year, direction and one parent column.

    An unknown parent means ``tegund0``, and where the table lacks that, the first of ``parents`` that it has.
    """
    held = [c for c in ("tegund0", *parents) if c in df.columns]
    tests: dict[str, object] = {}
    if year is not None and year != ALL:
        tests["year"] = int(year)
    if direction != ALL:
        tests["direction"] = direction
    if value != ALL:
        tests[parent if parent in parents and parent in df.columns else held[0]] = value
    return apply_filters(df, filters=tests)


def pair_exists(df: DataFrame, values: Mapping[str, object]) -> bool:
    """Whether any row has these values; stops at the first hit."""
    return not apply_filters(df, filters=values).limit(1).isEmpty()
