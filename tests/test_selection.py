"""Exact medians of long series, and the sketches in front of a profile."""

from __future__ import annotations

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from saldo.operators import anomalies, explore, selection

NAN, INF = float("nan"), float("inf")


def series(kind, n):
    rng = random.Random(f"{kind}{n}")
    make = {
        "even": lambda i: float(i),
        "wild": lambda i: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300),
        "equal": lambda i: 2.5,
        "two": lambda i: float(i % 2),
        "ends": lambda i: rng.choice([1.7e308, -1.7e308, 0.0, 5e-324]),
        "near": lambda i: 1.0 + rng.randint(0, 3) * 2.0**-52,
    }[kind]
    return [make(i) for i in range(n)]


@pytest.mark.parametrize("buckets", [2, 1024])
def test_medians(spark, buckets):
    data = {f"{kind}{n}": series(kind, n) for kind in ("even", "wild", "equal", "two", "ends", "near") for n in (1, 2, 51, 60)}
    data[None] = series("wild", 55)
    data["gaps"] = [1.0, None, 3.0, NAN] * 30
    rows = [(k, "x", v) for k, values in data.items() for v in values] + [("none", "x", None)]
    df = spark.createDataFrame(rows, "a string, median string, v double").repartition(3)
    chosen = ["even51", "even60", "two60", "gaps"] if buckets == 2 else list(data)
    df = df.where(F.col("a").isin([c for c in chosen if c]) | F.col("a").isNull())
    got = {r["a"]: r["median"] for r in selection.medians(df, ["a"], "v", long=50, buckets=buckets).collect()}
    assert set(got) == {*chosen, None}
    for key, found in got.items():
        want = [v for v in data[key] if v is not None and v == v]
        low, high = sorted(want)[(len(want) - 1) // 2], sorted(want)[len(want) // 2]
        assert found == (low if low == high else low / 2 + high / 2), key


def test_robust_stats_and_scores_equal_the_window_form(spark):
    rng = random.Random(3)
    rows = [(i % 7 if i % 7 else None, "ab"[i % 2], float(rng.randint(-50, 50)) if i % 11 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "k int, j string, v double")
    stats = {(r["k"], r["j"]): (r["median"], r["mad"]) for r in selection.robust_stats(df, ["k", "j"], "v", long=100).collect()}
    for (k, j), (mid, mad) in stats.items():
        values = [v for a, b, v in rows if (a, b) == (k, j) and v is not None]
        assert (mid, mad) == (median(values), median(abs(v - mid) for v in values))
    assert len(stats) == 14
    for long in (100, 10_000):
        got = selection.modified_zscore(df, ["k", "j"], "v", "z", long=long)
        want = anomalies.modified_zscore(df, ["k", "j"], "v", "z")
        shown = [sorted(map(str, d.select("k", "j", "v", F.round("z", 9).alias("z")).collect())) for d in (got, want)]
        assert shown[0] == shown[1]


def test_no_rows(spark):
    df = spark.createDataFrame([], "k int, v double")
    assert selection.medians(df, ["k"], "v").collect() == [] and selection.robust_stats(df, ["k"], "v").collect() == []


def test_sketches_leave_wide_columns_out(spark):
    df = spark.range(3000).select(
        F.col("id").alias("wide"), (F.col("id") % 200).alias("edge"), (F.col("id") % 201).alias("over"), F.lit(1).alias("one"),
        F.lit(None).cast("string").alias("none"), (F.col("id") % 2 == 0).alias("flag"),
    )
    assert explore.narrow_columns(df, df.columns, 200) == ["edge", "over", "one", "none", "flag"]
    got = [tuple(r) for r in explore.category_profile(df, [*df.columns, "absent"]).collect()]
    assert got == [("edge", 200), ("flag", 2)]
    assert explore.category_profile(df, ["wide"]).collect() == []
