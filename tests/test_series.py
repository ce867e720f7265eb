"""Price index and anomaly scoring."""

from __future__ import annotations

import json
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from saldo.functions.periods import month_key
from saldo.operators import anomalies, filters, ordering, price_index
from saldo.plans.star import STAR_PROFILE, star_ledger
from saldo.settings import SERIES_KEYS, AnomalyConfig
from saldo.sources import results

CONFIG = AnomalyConfig(min_prior_real_abs=20_000, min_abs_real_change=50_000)


def formula_index(spark, first=1995, last=2001):
    """A reply with the value 100 + 3 * (year - first) + month / 4, written with a comma."""
    months = price_index.month_keys(spark, first, last)
    value = 100 + 3 * (F.col("year") - first) + 0.25 * (F.col("month") - 1)
    item = F.struct(F.array("month_key").alias("key"), F.array(F.translate(F.format_number(value, 2), ".", ",")).alias("values"))
    body = months.agg(F.to_json(F.struct(F.collect_list(item).alias("data"))).alias("body"))
    return price_index.parse_index_json(body)


def test_parse_index_json(spark):
    data = [
        {"key": ["2020M02", "CPI"], "values": ["101,5", "9"]}, {"key": ["2020M01"], "values": ["100.5"]},
        {"key": [], "values": ["1"]}, {"key": ["2020M03"], "values": []}, {"key": ["2020M04"], "values": [".."]},
        {"key": ["2019M12"], "values": ["99"]},
    ]
    df = spark.createDataFrame([(json.dumps({"data": data}),)], "body string")
    got = [tuple(r) for r in price_index.parse_index_json(df).collect()]
    assert got == [(2019, 12, "2019M12", 99.0), (2020, 1, "2020M01", 1005.0), (2020, 2, "2020M02", 101.5)]


def test_annual_index(spark):
    monthly = spark.createDataFrame([(2020, 100.0), (2020, 110.0), (2021, 126.0)], "year int, cpi double")
    got = [tuple(r) for r in price_index.annual_index(monthly).orderBy("year").collect()]
    assert got == [(2020, 105.0, 126.0, 1.2), (2021, 126.0, 126.0, 1.0)]


def test_month_keys(spark):
    keys = [r[0] for r in price_index.month_keys(spark, 2019, 2020).orderBy("month_key").collect()]
    assert len(keys) == 24 and keys[0] == "2019M01" and keys[-1] == "2020M12"


def test_requested_months_reach_the_as_of_year(spark):
    df = spark.createDataFrame([("2018",), ("x",), ("2019.0",)], "year string")
    years = price_index.requested_months(df, as_of_year=2021).agg(F.min("year"), F.max("year"), F.count("*")).first()
    assert tuple(years) == (2018, 2021, 48)


def series(spark, values, start=2010):
    rows = [("k", start + i, float(v)) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "k string, year int, actual_real double")


def scored(spark, values):
    return anomalies.score_series(series(spark, values), ["k"], AnomalyConfig(min_prior_real_abs=1, min_abs_real_change=1)).orderBy("year").collect()


def test_first_row_is_a_decrease_and_no_anomaly(spark):
    first = scored(spark, [100, 200])[0]
    assert (first["direction"], first["prior_real"], first["is_anomaly"], first["anomaly_score"]) == ("decrease", None, False, 0.0)


def test_gap_years_are_not_filled(spark):
    rows = scored(spark, [100, None, 150])
    assert rows[1]["prior_real"] == 100.0 and rows[1]["series_year_count"] == 2


def test_previous_value_of_zero_or_below(spark):
    rows = scored(spark, [0, 50, -50, -100])
    assert [r["yoy_real_pct"] for r in rows] == [None, None, -2.0, -1.0]
    assert [r["direction"] for r in rows] == ["decrease", "increase", "decrease", "decrease"]


def test_no_spread_gives_no_score(spark):
    rows = scored(spark, [100, 200, 400, 800, 1600])
    assert {r["mz_yoy_pct"] for r in rows} == {None} and not any(r["is_anomaly"] for r in rows)


def test_flag_and_score(spark):
    rows = scored(spark, [100, 101, 103, 104, 107, 300])
    pct = [b / a - 1 for a, b in zip([100, 101, 103, 104, 107], [101, 103, 104, 107, 300])]
    mid = statistics.median(pct)
    mad = statistics.median(abs(p - mid) for p in pct)
    z = 0.6745 * (pct[-1] - mid) / mad
    assert [r["is_anomaly"] for r in rows] == [False] * 5 + [True]
    assert rows[-1]["mz_yoy_pct"] == pytest.approx(z)
    assert rows[-1]["anomaly_score"] == pytest.approx(0.7 * z + 30 * pct[-1])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-50, 50), min_size=1, max_size=9))
def test_zscore_agrees_with_plain_python(spark, values):
    got = [r["z"] for r in anomalies.modified_zscore(series(spark, values), ["k"], "actual_real", "z").orderBy("year").collect()]
    mid = statistics.median(values)
    mad = statistics.median([abs(v - mid) for v in values])
    assert got == [None if mad == 0 else pytest.approx(0.6745 * (v - mid) / mad) for v in values]


def test_annual_actuals_drop_unusable_rows(spark):
    df = spark.createDataFrame(
        [("2020", "a", "1,5"), ("2020.0", "a", "2"), ("x", "a", "1"), ("2020", None, "3"), ("2020", "a", "bad")],
        "year string, k string, raun string",
    )
    got = sorted(tuple(r) for r in anomalies.annual_actuals(df, ["k", "absent"]).collect())
    assert got == [(2020, "(missing)", 3.0), (2020, "a", 3.5)]


def test_pinned_flags(spark, sf_pinned):
    rows = star_ledger(spark, sf_pinned, ["year", "samtala0", "samtala2", "raun"])
    index = price_index.annual_index(formula_index(spark))
    out = anomalies.detect_anomalies(rows, index, ["samtala0", "samtala2"], CONFIG)
    assert (out.count(), out.filter("is_anomaly").count()) == (875, 54)
    assert out.filter(F.col("is_anomaly").isNull()).count() == 0
    default = anomalies.detect_anomalies(rows, index, ["samtala0", "samtala2"])
    assert default.filter("is_anomaly").count() == 0


def test_full_series_keys(spark, sf_dir):
    index = price_index.annual_index(formula_index(spark))
    out = anomalies.detect_anomalies(star_ledger(spark, sf_dir), index, SERIES_KEYS, CONFIG)
    assert set(SERIES_KEYS) <= set(out.columns)
    assert out.filter(F.col("tegund2") != "(missing)").count() == 0


def test_result_does_not_depend_on_partitions(spark, sf_dir):
    rows = star_ledger(spark, sf_dir, ["year", "samtala0", "samtala2", "raun"])
    index = price_index.annual_index(formula_index(spark))
    def run(df):
        out = anomalies.detect_anomalies(df, index, ["samtala0", "samtala2"], CONFIG)
        return sorted((r["year"], r["samtala0"], r["samtala2"], round(r["anomaly_score"], 6)) for r in out.collect())
    assert run(rows) == run(rows.repartition(17))


def test_page_lists_follow_the_displayed_department(spark):
    keys = "year int, samtala0 string, samtala2 string, actual_real double"
    rows = spark.createDataFrame(
        [(2020, "i", "HOUSEHOLD", 1.0), (2020, "i", "FURNITURE", 2.0), (2021, "i", "HOUSEHOLD", 4.5), (2020, "j", None, 9.0)], keys
    )
    mapped = filters.with_departments(rows, STAR_PROFILE)
    columns = ["samtala0", "samtala2_canonical"]
    page = ordering.page(mapped.select(*columns).distinct(), ["samtala0"])
    got = {r["samtala0"]: r["year_totals"] for r in anomalies.attach_series_totals(page, mapped, columns).collect()}
    assert [tuple(t) for t in got["i"]] == [(2020, 3.0, "3"), (2021, 4.5, "4,50")]
    assert got["j"] == []


def test_browse_filter(spark):
    df = spark.createDataFrame([(2020, "increase", "a", "x"), (2021, "decrease", "b", "x")], "year int, direction string, tegund0 string, k string")
    assert filters.filter_anomalies(df, ["k"], year="2020").count() == 1
    assert filters.filter_anomalies(df, ["k"], direction="decrease").count() == 1
    assert filters.filter_anomalies(df, ["k"], parent="unknown", value="a").count() == 1
    with pytest.raises(ValueError):
        filters.filter_anomalies(df, ["k"], year="x")


def test_write_anomalies(spark, sf_dir, tmp_path):
    monthly = formula_index(spark)
    index = price_index.annual_index(monthly)
    rows = star_ledger(spark, sf_dir, ["year", "samtala0", "samtala2", "raun"])
    out = anomalies.detect_anomalies(rows, index, ["samtala0", "samtala2"], CONFIG)
    folder = str(tmp_path)
    results.write_anomalies(out, monthly, index, folder, CONFIG)
    stored = spark.read.parquet(f"{folder}/anomalies_yoy_all")
    hits = spark.read.parquet(f"{folder}/anomalies_flagged")
    summary = spark.read.json(f"{folder}/anomalies_summary").first()
    assert (stored.count(), hits.count()) == (summary["rows_total"], summary["rows_flagged"]) == (out.count(), out.filter("is_anomaly").count())
    assert (summary["year_from"], summary["year_to"], summary["z_threshold"]) == (1995, 2001, 3.5)
    assert spark.read.option("header", True).csv(f"{folder}/anomalies_flagged_csv").count() == hits.count()
    assert spark.read.option("header", True).csv(f"{folder}/index_monthly_csv").count() == 84


def test_month_key_text(spark):
    assert spark.range(1).select(month_key(F.lit(2020), F.lit(3))).first()[0] == "2020M03"


def test_index_values_and_years_are_not_dropped(spark):
    body = spark.createDataFrame([('{"data":[{"key":["2020M01"],"values":["1234567890123,5"]}]}',)], "body string")
    assert [r["cpi"] for r in price_index.parse_index_json(body).collect()] == [1234567890123.5]
    odd = spark.createDataFrame([('{"data":[{"key":["January"],"values":["1"]}]}',)], "body string")
    with pytest.raises(Exception, match="no month key"):
        price_index.parse_index_json(odd).collect()
    facts = spark.createDataFrame([(12020, 1.0)], "year int, v double")
    annual = spark.createDataFrame([(12020, 2.0)], "year int, deflator_to_latest double")
    assert price_index.deflate(facts, annual).count() == 1
