"""Small text helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "(missing)"


def clean(col: Column) -> Column:
    """Trim blanks (only blanks) on both sides."""
    return F.trim(col)


def strip_space(col: Column) -> Column:
    """Trim every kind of white space on both sides."""
    # Most texts have no such space, which is cheap to see; only the others go through the pattern.
    edged = col.rlike(r"(?U)^\s|\s\z")
    return F.when(edged, F.regexp_replace(col, r"(?U)^\s+|(?<!\s)\s+\z", "")).otherwise(col)


def digits_only(col: Column) -> Column:
    """Keep the digits. Blank text is NULL, but text without any digit becomes the empty text."""
    stripped = strip_space(col.cast("string"))
    return F.when(stripped != "", F.regexp_replace(stripped, r"(?U)\D+", ""))


def contains_ci(col: Column, phrase: str) -> Column:
    """Substring test that ignores case."""
    return F.lower(col).contains(phrase.lower())


def map_values(col: Column, mapping: Mapping[str, str]) -> Column:
    """Trim, then replace the values found in ``mapping``; other values stay."""
    trimmed = clean(col)
    out = None
    for source, target in mapping.items():
        test = trimmed == source
        out = F.when(test, target) if out is None else out.when(test, target)
    return trimmed if out is None else out.otherwise(trimmed)


def key_text(col: Column) -> Column:
    """A series key as text, with a marker in place of NULL."""
    return F.coalesce(col.cast("string"), F.lit(MISSING))
