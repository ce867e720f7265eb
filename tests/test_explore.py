from __future__ import annotations

import os
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from saldo.operators import drill, explore, filters, joins, ordering
from saldo.settings import LedgerProfile

ROWS = [
    (2020, "a", "x", "1,5"), (2020, "a", "y", "-2"), (2021, "b", "x", "bad"), (2021, None, "y", "4"),
    (None, "b", None, "1.000"), (2021, "a", "x", None),
]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "year int, k string, t string, raun string")


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_summary_puts_missing_sums_last(df):
    assert rows(explore.summary_by(df, "k")) == [("b", 1000.0), (None, 4.0), ("a", -0.5)]
    assert rows(explore.summary_by(df.filter("year = 2021"), "k")) == [(None, 4.0), ("a", None), ("b", None)]


def test_totals(df):
    assert rows(explore.totals(df)) == [(6, 1003.5, 1005.5, -2.0)]
    assert rows(explore.totals(df, filters={"k": "none"})) == [(0, 0.0, 0.0, 0.0)]


def test_year_filter_ignores_unusable_values(df):
    counts = [explore.count_rows(df, year=y).first()[0] for y in (None, "all", "x", "", "2021", 2021)]
    assert counts == [6, 6, 6, 6, 3, 3]


def test_filter_can_leave_out_a_column(df):
    assert filters.apply_filters(df, 2020, {"k": "a", "t": "x"}, exclude="t").count() == 2


def test_not_in_drops_null(df):
    assert rows(filters.exclude_values(df, "k", ["a"]).select("k").distinct()) == [("b",)]
    assert df.filter(filters.differs("k", "a")).count() == 3


@pytest.mark.parametrize("chosen", [{}, {"k": "a"}, {"k": "a", "t": "y"}, {"k": "none", "t": "x"}])
@pytest.mark.parametrize("year", [None, 2021])
def test_facets_equal_one_query_per_column(df, chosen, year):
    columns = ["k", "t", "absent"]
    got = {c: [] for c in columns[:2]}
    for r in explore.facet_options(df, columns, chosen, year).orderBy("facet", "position").collect():
        got[r["facet"]].append(r["value"])
    for c in columns[:2]:
        plain = filters.apply_filters(df, year, chosen, exclude=c)
        assert got[c] == [r[0] for r in ordering.distinct_values(plain, c, 200).collect()]


def test_facets_are_capped(spark):
    many = spark.range(1000).select(F.format_string("%04d", "id").alias("k"))
    got = explore.facet_options(many, ["k"], most=200).orderBy("position").collect()
    assert len(got) == 200 and got[-1]["value"] == "0199"


def test_category_profile(spark):
    df = spark.range(300).select((F.col("id") % 3).cast("string").alias("few"), F.lit("c").alias("one"), F.col("id").cast("string").alias("many"))
    assert rows(explore.category_profile(df, ["few", "one", "many", "absent"])) == [("few", 3)]


def test_preview_limit_is_clamped(spark):
    df = spark.range(600).toDF("id")
    assert explore.preview(df, limit=9999).count() == 500
    assert explore.preview(df, limit=-3).count() == 1


@pytest.mark.parametrize(
    "number, size, first, count, shown",
    [(0, 100, 0, 100, 1), (1, 10, 0, 25, 1), (3, 100, 200, 100, 3), (99, 100, 600, 30, 7), (2, 9999, 500, 130, 2)],
)
def test_page(spark, number, size, first, count, shown):
    page = ordering.page(spark.range(630).toDF("id"), ["id"], number, size)
    ids = [r[0] for r in page.rows.collect()]
    assert (ids[0], len(ids), page.number, page.total) == (first, count, shown, 630)


def test_page_of_nothing(spark):
    page = ordering.page(spark.range(0).toDF("id"), ["id"], 5)
    assert (page.rows.count(), page.number, page.pages, page.total) == (0, 1, 1, 0)


@pytest.mark.parametrize("number", [1, 2, 7, 8, 20, 33, 39, 40])
def test_deep_pages(spark, number):
    """Every way to a page gives the rows that slicing a sorted list gives."""
    df = spark.range(1000).select(
        F.when(F.col("id") % 9 != 0, F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 400).alias("b")
    )
    everything = sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    page = ordering.page(df, ["-a"], number, 25)
    assert rows(page.rows) == everything[(number - 1) * 25 : number * 25]


def test_deep_page_of_equal_rows(spark):
    df = spark.range(1000).select(F.lit(1).alias("a"))
    assert rows(ordering.page(df, ["a"], 20, 25).rows) == [(1,)] * 25


def test_pages_of_one_index(spark):
    df = spark.range(4000).select((F.col("id") % 50).alias("a"), F.lit("x").alias("row"), (-F.col("id")).alias("part"))
    pager = ordering.Pager(df)
    want = sorted((tuple(r) for r in df.collect()), key=lambda r: (-r[0], r[1], r[2]))
    plans = []
    for number in (1, 3, 40, 41, 99):
        page = pager.page(["-a"], number, 100)
        at = min(number, 40) - 1
        assert rows(page.rows) == want[at * 100 : at * 100 + 100] and (page.pages, page.total) == (40, 4000)
        plans.append(page.rows._jdf.queryExecution().executedPlan().toString())
    assert all("Exchange" not in p.replace("Coalesce", "") and "PartitionFilters: [isnotnull(part" in p for p in plans)
    parts = page.rows.inputFiles()
    assert rows(pager.page(["part"], 1, 25).rows)[0][2] == -3999
    pager.replace(df.limit(10))
    assert not any(os.path.exists(unquote(f.removeprefix("file://"))) for f in parts)
    assert pager.page(["-a"], 1).total == 10
    pager.close()


def test_equal_rows_are_spread_over_parts(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 100).alias("a"), F.lit(1).alias("row_number"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ordering.spread_sort(df.repartition(8), [F.desc("a")])
        sizes = [len(part) for part in out.rdd.glom().collect()]
        assert out.columns == df.columns and sum(sizes) == 20_000 and max(sizes) < 2 * 20_000 / len(sizes)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_mixed_sort(spark):
    given = ["b", "1.200", "12,5%", "A", "", "-3", "1,2,3", "7 %", "9e2"]
    df = spark.createDataFrame([(v,) for v in given], "v string")
    up = [r[0] for r in ordering.mixed_sort(df, "v").collect()]
    assert up == ["-3", "7 %", "12,5%", "9e2", "1.200", "", "1,2,3", "A", "b"]
    down = [r[0] for r in ordering.mixed_sort(df, "v", descending=True).collect()]
    assert down == ["1.200", "9e2", "12,5%", "7 %", "-3", "b", "A", "1,2,3", ""]


def test_drill(df):
    assert rows(drill.yearly_sum(df, {"k": "a"})) == [(2020, -0.5), (2021, 0.0)]
    assert rows(drill.breakdown(df, {"k": "a"}, "t")) == [("y", -2.0, 1), ("x", 1.5, 2)]
    assert rows(drill.export_scope(df, {"k": "a"}, ["year", "t", "year", "absent"])) == [
        (2021, "x"), (2020, "x"), (2020, "y"),
    ]
    assert drill.scope_rows(df, {}, ["year", "k"], k=2).count() == 2


def test_pair_exists(df):
    assert filters.pair_exists(df, {"k": "a", "t": "y"})
    assert not filters.pair_exists(df, {"k": "b", "t": "y"})


def test_departments(spark):
    df = spark.createDataFrame([(" Frístund ",), ("Búsetuþjónusta",), ("Annað ",), (None,)], "samtala2 string")
    got = rows(filters.with_departments(df, LedgerProfile()).drop("samtala2"))
    assert got == [
        ("Frístund", "Frístundastarf", "Frístund / Frístundastarf"),
        ("Búsetuþjónusta", "Búsetuþjónusta", "Búsetuúrræði / Búsetuþjónusta"),
        ("Annað", "Annað", "Annað"),
        (None, None, None),
    ]
    assert LedgerProfile(department_mode=" RAW ").department == "samtala2_raw"
    assert LedgerProfile(department_mode="?").department == "samtala2_canonical"


def test_full_years(spark):
    df = spark.createDataFrame([(2020, "12.0"), (2020, "1"), (2021, "8"), (None, "12"), (2022, "x")], "year int, period_month string")
    assert rows(joins.full_years(df)) == [(2020,)]
    sums = spark.createDataFrame([(2020, 1), (2021, 2), (None, 3)], "year int, v int")
    assert rows(joins.only_full_years(sums, df)) == [(2020, 1)]
    assert rows(joins.only_full_years(sums, df.select("year"))) == [(2020, 1), (2021, 2)]


def test_key_joins(spark):
    facts = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("b", "x", 3)], "k string, t string, v int")
    keys = spark.createDataFrame([("a", "x"), ("a", None)], "k string, t string")
    assert rows(joins.rows_for_keys(facts, keys, ["k", "t"])) == [("a", "x", 1)]
    assert rows(joins.only_new(keys, facts.filter("t = 'x'"), "t").select("k", "t")) == [("a", None)]
    firsts = ordering.first_seen(spark.createDataFrame([("u", 3), ("u", 1), ("w", 2)], "link string, p int"), "link", "p")
    assert sorted(rows(firsts)) == [("u", 1), ("w", 2)]
