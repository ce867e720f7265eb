"""Numbers written with a dot for thousands and a comma for decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ten digits fewer than the widest decimal: Spark widens a sum by ten, so sums keep all digits.
AMOUNT_PRECISION = 28
PLAIN_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _fitted(value: Column, plain: Column, precision: int, scale: int) -> Column:
    """The value as a decimal; a number that does not fit is an error and never a silent NULL."""
    kind = T.DecimalType(precision, scale)
    amount = value.try_cast(kind)
    wide = F.raise_error(F.concat(F.lit(f"no decimal({precision},{scale}): "), value.cast("string"))).cast(kind)
    return F.when(amount.isNull() & plain, wide).otherwise(amount)


def parse_number(text: Column, scale: int = 2, precision: int = AMOUNT_PRECISION) -> Column:
    """Text such as ``1.234,56`` as a decimal; NULL when it is not a number, an error when it is too wide.

    A decimal target accepts signs, ``,5``, ``12,`` and exponents, and turns ``inf``, ``nan``,
    ``1d`` and ``1_000`` into NULL. Digits beyond ``scale`` are rounded half up.
    """
    bare = F.translate(text, ",.", ".")
    return _fitted(bare, bare.rlike(PLAIN_NUMBER), precision, scale)


def measure(df: DataFrame, name: str, scale: int = 2, precision: int = AMOUNT_PRECISION) -> Column:
    """The measure column as a decimal: text is parsed, narrower decimals and whole numbers pass through."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return parse_number(F.col(name), scale, precision)
    if isinstance(kind, T.DecimalType) and kind.scale <= scale and kind.precision <= precision:
        return F.col(name)
    # NaN and infinity are no amounts; they differ from themselves when taken from themselves.
    finite = F.col(name).isNotNull() & (F.col(name).cast("double") - F.col(name).cast("double") == 0)
    return _fitted(F.col(name), finite, precision, scale)


def format_number(number: Column) -> Column:
    """``1.234`` for whole numbers, ``1.234,56`` otherwise, empty text for NULL."""
    # Adding zero turns a negative zero into a plain one.
    value = number.cast("double") + F.lit(0.0)
    whole = F.format_number(value, 0)
    cents = F.format_number(value, 2)
    shown = F.when(value == F.rint(value), whole).otherwise(cents)
    return F.coalesce(F.translate(shown, ",.", ".,"), F.lit(""))


def format_text_number(text: Column) -> Column:
    """As :func:`format_number` for a text cell; text that is no number is kept as it stands."""
    number = F.translate(F.trim(text), ",.", ".").try_cast(T.DecimalType(38, 10))
    return F.when(number.isNotNull(), format_number(number)).otherwise(F.coalesce(text, F.lit("")))


def format_grouped(number: Column) -> Column:
    """Comma-grouped text rounded to two decimals (``1,234.5``), for other measures."""
    shown = F.regexp_replace(F.format_number(number.cast("double") + F.lit(0.0), 2), "0$", "")
    return F.coalesce(shown, F.lit(""))


def format_percent(percent: Column) -> Column:
    """``12.3%``; empty text for NULL."""
    digits = F.translate(F.format_number(percent.cast("double"), 1), ",", "")
    return F.coalesce(F.concat(digits, F.lit("%")), F.lit(""))


def format_score(score: Column) -> Column:
    """Two plain decimals; a missing score counts as zero."""
    return F.translate(F.format_number(F.coalesce(score.cast("double"), F.lit(0.0)), 2), ",", "")


def share_percent(part: Column, other: Column) -> Column:
    """``part`` as a percentage of ``part + other``; 0 when the sum is zero or missing."""
    own = F.coalesce(part, F.lit(0)).cast("double")
    total = own + F.coalesce(other, F.lit(0)).cast("double")
    return F.when(total != 0, own / total * 100.0).otherwise(F.lit(0.0))


def to_year(col: Column) -> Column:
    """A year as integer from text or number (``2020.0`` gives 2020); NULL when unusable."""
    return col.try_cast("double").try_cast("int")


def to_month(col: Column) -> Column:
    """A month as integer; text such as ``12.0`` is accepted."""
    return col.try_cast("double").try_cast("int")
