from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from saldo.operators import wages
from saldo.plans.queries import REPORT_COLUMNS, ledger, months
from saldo.plans.star import STAR_PROFILE
from saldo.settings import LedgerProfile

PROFILE = LedgerProfile(wage_group="W", excluded=("out",), canonical={}, detail=("samtala1", "vm_numer"))
SCHEMA = "year int, period_month int, samtala2_canonical string, samtala0 string, samtala1 string, vm_numer string, tegund0 string, raun string"


@pytest.fixture
def df(spark):
    rows = [
        (2019, 12, "d", "i", "u", "1", "W", "100"), (2020, 12, "d", "i", "u", "1", "W", "150"),
        (2021, 6, "d", "i", "u", "1", "W", "900"),
        (2020, 1, "d", "i", "u", None, "O", "60"), (2020, 1, "d", "j", "u", None, "O", "-50"),
        (2020, 1, "d", "j", "u", "", None, "5"), (2019, 1, "d", "j", "u", "2", "W", "-30"),
        (2019, 1, "e", "i", None, None, "O", "40"), (None, 1, "e", "i", None, None, "W", "7"),
        (2020, 1, "out", "i", "u", "1", "W", "999"), (2020, 1, None, "i", "u", "1", "W", "999"),
        (2020, 1, "d", None, "u", "1", "W", "11"), (2020, 1, "g", "i", "u", "1", "W", "bad"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def by(frame, key):
    return {r[key]: r for r in frame.collect()}


def test_department_report(df):
    got = by(wages.department_report(df, PROFILE), "department")
    assert set(got) == {"d", "e", "g"}
    d = got["d"]
    assert (d["actual_sum"], d["row_count"]) == (1131.0, 8)
    # Cells of 2020: i/u/'' other 60; j/u/'' other -50 + 5 = -45, clamped. Of 2019: j/u/2 wages -30, clamped.
    assert (d["wage_cost_sum"], d["other_sum"]) == (1161.0, 60.0)
    # Full years are 2019 (70) and 2020 (161); 2021 ends in June.
    assert d["avg_increase_pct"] == pytest.approx((161 / 70 - 1) * 100)
    assert d["wage_share_pct"] == pytest.approx(1161 / 1221 * 100)
    e = got["e"]
    assert (e["actual_sum"], e["row_count"], e["wage_cost_sum"], e["other_sum"]) == (7.0, 2, 0.0, 40.0)
    assert e["avg_increase_pct"] is None and e["wage_share_pct"] == 0.0
    assert (got["g"]["actual_sum"], got["g"]["wage_cost_sum"]) == (None, 0.0)


def test_rows_are_sorted_with_missing_sums_last(df):
    assert [r["department"] for r in wages.department_report(df, PROFILE).collect()] == ["d", "e", "g"]


def test_report_of_one_year_keeps_growth_of_all(df):
    got = by(wages.department_report(df, PROFILE, "2019"), "department")
    assert set(got) == {"d", "e"}
    assert (got["d"]["actual_sum"], got["d"]["row_count"]) == (70.0, 2)
    assert got["d"]["avg_increase_pct"] == pytest.approx((161 / 70 - 1) * 100)


def test_total_row(df):
    total = wages.department_total(df, PROFILE).first()
    report = wages.department_report(df, PROFILE).collect()
    assert total["label"] == "Total"
    for figure in ("actual_sum", "other_sum", "wage_cost_sum", "row_count"):
        assert total[figure] == sum(r[figure] or 0 for r in report)
    assert total["wage_share_pct"] == pytest.approx(1161 / (1161 + 100) * 100)
    # Growth of the scope, not the mean of the groups.
    assert total["avg_increase_pct"] == pytest.approx((161 / 70 - 1) * 100)


def test_total_of_nothing(df):
    assert wages.department_report(df, PROFILE, 1900).count() == 0
    total = wages.department_total(df, PROFILE, 1900).first()
    assert (total["actual_sum"], total["row_count"], total["wage_share_pct"]) == (0.0, 0, 0.0)


def test_institution_report_and_expansion(df):
    got = by(wages.institution_report(df, PROFILE, "d"), "institution")
    assert set(got) == {"i", "j"}
    assert (got["i"]["actual_sum"], got["i"]["other_sum"]) == (1150.0, 60.0)
    assert got["i"]["avg_increase_pct"] == pytest.approx(50.0)
    assert got["j"]["avg_increase_pct"] == pytest.approx(-100.0)
    total = wages.institution_total(df, PROFILE, "d").first()
    assert (total["actual_sum"], total["row_count"]) == (1120.0, 7)
    opened = by(wages.institution_expansion(df, PROFILE, "d"), "institution")
    for name, row in got.items():
        for figure in ("actual_sum", "other_sum", "wage_cost_sum", "row_count", "wage_share_pct"):
            assert opened[name][figure] == row[figure]


def test_share_trend_nets_across_institutions(df):
    got = {r["year"]: r["wage_share_pct"] for r in wages.share_trend(df, PROFILE, "d").collect()}
    # In 2020 the cell u/'' nets 60 - 50 + 5 = 15, and wages are 161.
    assert got[2020] == pytest.approx(161 / 176 * 100)
    alone = {r["year"]: r["wage_share_pct"] for r in wages.share_trend(df, PROFILE, "d", "j").collect()}
    assert alone == {2019: None, 2020: None}


def test_wage_scope_yearly(df):
    assert [tuple(r) for r in wages.wage_scope_yearly(df, PROFILE).collect()] == [(2019, 70.0), (2020, 161.0), (2021, 900.0)]
    assert [tuple(r) for r in wages.wage_scope_yearly(df, PROFILE, "d", "j").collect()] == [(2019, -30.0)]


def test_growth_uses_the_signed_previous_value(spark):
    df = spark.createDataFrame([("a", 1, -10.0), ("a", 2, -5.0), ("a", 3, 0.0), ("a", 4, 3.0)], "k string, year int, v double")
    got = [r["yoy_pct"] for r in wages.yoy_pct(df, ["k"], "v").orderBy("year").collect()]
    assert got == [None, -50.0, -100.0, None]


def test_without_months_every_year_is_full(df):
    got = by(wages.department_report(df.drop("period_month"), PROFILE), "department")
    assert got["d"]["avg_increase_pct"] == pytest.approx(((161 / 70 - 1) + (900 / 161 - 1)) * 50)


def test_pinned_netting_grains(spark, sf_pinned):
    rows = ledger(spark, sf_pinned, REPORT_COLUMNS)
    report = by(wages.department_report(rows, STAR_PROFILE, 1999, months(spark, sf_pinned)), "department")["BUILDING"]
    assert (report["wage_cost_sum"], report["other_sum"]) == (11248189.35, 51802346.20)
    scope = wages.apply_filters(rows, 1999, {"samtala2_canonical": "BUILDING"})
    trend = wages.cost_totals(wages.cost_basis(scope, STAR_PROFILE, ["year"], STAR_PROFILE.detail), ["year"]).first()
    assert (trend["wage_cost_sum"], trend["other_sum"]) == (10597285.50, 42821776.50)


def test_a_group_with_a_third_of_all_rows(spark):
    """Hot cells give the same figures as brute force over the collected rows."""
    n = 30_000
    hot = F.col("id") % 3 == 0
    df = spark.range(n).select(
        (2019 + F.col("id") % 2).cast("int").alias("year"), F.lit(12).alias("period_month"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 50)).alias("samtala2_canonical"),
        F.when(hot, "i").otherwise(F.concat(F.lit("i"), F.col("id") % 7)).alias("samtala0"),
        F.lit(None).cast("string").alias("samtala1"), (F.col("id") % 11).cast("string").alias("vm_numer"),
        F.when(F.col("id") % 5 < 2, "W").otherwise("O").alias("tegund0"),
        ((F.col("id") * 37) % 1001 - 500).cast("string").alias("raun"),
    )
    cells, want = {}, {}
    for r in df.collect():
        key = (r["samtala2_canonical"], r["year"], r["samtala0"], r["vm_numer"])
        cell = cells.setdefault(key, [0, 0])
        cell[r["tegund0"] != "W"] += int(r["raun"])
    for (dept, *_), (w, o) in cells.items():
        total = want.setdefault(dept, [0, 0])
        total[0] += max(w, 0)
        total[1] += max(o, 0)
    got = {r["department"]: [r["wage_cost_sum"], r["other_sum"]] for r in wages.department_report(df, PROFILE).collect()}
    assert got == want
