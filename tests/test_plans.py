"""What the plans must and must not hold, whatever the data."""

from __future__ import annotations

import pathlib
import re

import pytest

from saldo.plans.queries import QUERIES
from saldo.plans.star import star_ledger


def queries():
    return QUERIES

ROOT = pathlib.Path(__file__).parent.parent


def plan(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[-1]


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_cross_joins(name, spark, sf_dir):
    text = plan(queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["wage_department_report", "wage_department_report_year", "wage_total_row", "wage_institution_report"])
def test_wage_reports_read_the_ledger_once(name, spark, sf_dir):
    assert plan(queries()[name](spark, sf_dir)).count("lineitem.parquet") == 1


@pytest.mark.parametrize("name", ["facet_options", "facet_options_open"])
def test_facet_cap_applies_before_the_shuffle(name, spark, sf_dir):
    assert re.search(r"WindowGroupLimit .*Partial", plan(queries()[name](spark, sf_dir)))


@pytest.mark.parametrize("name", ["preview_page", "scope_rows", "child_breakdown", "summary_by_category"])
def test_limits_are_top_k(name, spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(queries()[name](spark, sf_dir))


def test_series_windows_share_one_shuffle(spark, sf_dir):
    text = plan(queries()["anomalies_all"](spark, sf_dir))
    assert text.count("Window [") == 3 and len(re.findall(r"hashpartitioning\(samtala0#\d+, samtala2#\d+, \d+\)", text)) == 1


def test_unused_dimensions_are_left_out(spark, sf_dir):
    text = plan(star_ledger(spark, sf_dir, ["raun"]))
    assert "Join" not in text
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string>" in text


def test_sources_hold_no_driver_side_shortcuts():
    for path in (ROOT / "saldo").rglob("*.py"):
        source = path.read_text()
        for word in ("localCheckpoint", "toPandas", "crossJoin", ".rdd", "coalesce(1).write.parquet"):
            assert word not in source, (path, word)
