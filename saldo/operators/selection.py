"""Exact medians of series of any length, in bounded memory.

A short series is sorted by one task. A long one is narrowed down: its values are counted in buckets of equal width
between the least and the greatest, the bucket that holds the middle is kept, and its own least and greatest value
bound the next round. Counts are summed in the tasks, so a round moves at most ``buckets`` rows a series and task, and
no task ever holds a series. Buckets only have to keep the order of values, so rounding does no harm, and as the least and
the greatest value lie in different buckets, every round leaves fewer values.

There are at most as many long series as the rows divided by ``LONG``, so their bounds are small enough to be sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.operators.anomalies import MAD_SCALE
from saldo.sources.scratch import discard, stored

#: Values of a series that one task may hold.
LONG = 100_000
BUCKETS = 1024


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equal keys; missing ones are equal too."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def _beside(rows: DataFrame, bounds: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows with the bounds of their series."""
    joined = rows.join(F.broadcast(bounds), _same(rows, bounds, keys), how)
    return joined if how == "left_anti" else joined.select(*[rows[k] for k in keys], "x", *[c for c in bounds.columns if c not in keys])


def _narrowed(rows: DataFrame, bounds: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """The bucket of each series that holds the wanted rank, and the rank within it."""
    # Halves, so that the width of the widest range is a number.
    share = (F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
    # A width too small for a number leaves equal shares; then only the greatest value is set apart.
    bucket = F.when(F.col("x") == F.col("low"), 0).when(F.col("x") == F.col("high"), buckets + 1)
    bucket = bucket.otherwise(F.greatest(F.lit(0), F.least(F.lit(buckets), F.floor(share * buckets).cast("int"))))
    held = _beside(rows, bounds, keys).where(F.col("x").between(F.col("low"), F.col("high")))
    counts = held.groupBy(*keys, "rank", bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")
    )
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket"))
    middle = counts.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
    return middle.select(*keys, (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), "low", "high")


def _long_medians(rows: DataFrame, sizes: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    spark = rows.sparkSession
    state = stored(sizes.select(*keys, F.floor((F.col("n") - 1) / 2).alias("rank"), "low", "high"), "bounds")
    while not state.where("low < high").isEmpty():
        done = state.where("low >= high")
        following = stored(done.unionByName(_narrowed(rows, state.where("low < high"), keys, buckets)), "bounds")
        discard(spark, state)
        state = following
    # Of an even number of values the middle is half way to the next one.
    lower = state.select(*keys, F.col("low").alias("lower"))
    around = _beside(rows, lower, keys).groupBy(*keys, "lower").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("x") <= F.col("lower")).alias("upto"),
        F.min(F.when(F.col("x") > F.col("lower"), F.col("x"))).alias("next"),
    )
    single = (F.col("n") % 2 == 1) | (F.col("upto") > F.col("n") / 2)
    return around.select(*keys, F.when(single, F.col("lower")).otherwise(F.col("lower") / 2 + F.col("next") / 2).alias("median"))


def medians(df: DataFrame, keys: Sequence[str], value: str, long: int = LONG, buckets: int = BUCKETS) -> DataFrame:
    """The exact, interpolating median of the values of each series; missing values and NaN do not count.

    Series without values are absent. Missing keys are a series. The frame is read once and stored.
    """
    x = F.col(value).cast("double")
    rows = stored(df.select(*keys, x.alias("x")).where(x.isNotNull() & ~F.isnan(x)), "series")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    wide = stored(sizes.where(F.col("n") > long), "long-series")
    short = _beside(rows, wide.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.median("x").alias("median"))
    if wide.isEmpty():
        return short
    return stored(short.unionByName(_long_medians(rows, wide, keys, buckets)), "medians")


def robust_stats(df: DataFrame, keys: Sequence[str], value: str, long: int = LONG) -> DataFrame:
    """``median`` and ``mad``, the median absolute deviation from it, of each series."""
    mid = medians(df, keys, value, long)
    rows = df.select(*keys, F.col(value).cast("double").alias("x"))
    # No hint: series may be as many as rows.
    off = rows.join(mid, _same(rows, mid, keys)).select(*[rows[k] for k in keys], F.abs(F.col("x") - F.col("median")).alias("x"))
    spread = medians(off, keys, "x", long).withColumnRenamed("median", "mad")
    return mid.join(spread, _same(mid, spread, keys)).select(*[mid[k] for k in keys], "median", "mad")


def modified_zscore(df: DataFrame, keys: Sequence[str], value: str, name: str, long: int = LONG) -> DataFrame:
    """As :func:`saldo.operators.anomalies.modified_zscore`, for series that no task can hold."""
    stats = robust_stats(df, keys, value, long)
    score = F.when(F.col("mad") != 0, F.lit(MAD_SCALE) * (F.col(value) - F.col("median")) / F.col("mad"))
    joined = df.join(stats, _same(df, stats, keys), "left")
    return joined.select(*[df[c] for c in df.columns], score.alias(name))
