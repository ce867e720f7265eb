"""A ledger kept file by file, its partial sums, and views."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F

from saldo.operators import filters, wages
from saldo.plans.star import STAR_PROFILE, star_ledger
from saldo.settings import LedgerProfile
from saldo.sources import csv_folder, ledger
from saldo.sources.stored_ledger import StoredLedger, report_cells

HEAD = "samtala0,samtala2,tegund0,vm_numer,raun\n"
PROFILE = LedgerProfile(wage_group="W", excluded=("skip",))


def write(folder, name, *rows):
    (folder / name).write_text(HEAD + "".join(f"{r}\n" for r in rows))


def report(df):
    return [tuple(r) for r in wages.department_report(df, PROFILE).collect()] + [tuple(r) for r in wages.department_total(df, PROFILE).collect()]


def fresh(spark, folder):
    rows = csv_folder.read_csv_folder(spark, str(folder)).table
    return ledger.prepare_ledger(rows.withColumn("period_month", F.col("period_month").cast("string")), PROFILE)


def same(spark, kept, folder):
    want = fresh(spark, folder)
    columns = [c for c in want.columns if c != "ingested_at"]
    got = kept.read(spark)
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    assert report(kept.cells(spark)) == report(got) == report(want)
    assert kept.cells(spark).agg(F.sum("_rows")).first()[0] == want.count()


def stamps(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_files_are_added_replaced_and_removed(spark, tmp_path):
    folder, kept = tmp_path / "raw", StoredLedger(str(tmp_path / "kept"), PROFILE)
    folder.mkdir()
    write(folder, "a_202012.csv", "s1,d1,W,v1,\"10,5\"", "s1,d1,X,v1,3", "s2,skip,W,,1")
    write(folder, "b c_202112.csv", "s1,d1,W,v1,20", "s1,d1,W,v1,\"-3\"", "s3,d2,W,v2,7")
    write(folder, "c_202112.csv", "s1,d1,W,v1,1")
    update = kept.update(spark, str(folder))
    assert (update.taken, update.dropped) == (["a_202012.csv", "b c_202112.csv", "c_202112.csv"], [])
    same(spark, kept, folder)
    assert kept.update(spark, str(folder)).taken == []
    before = stamps(tmp_path / "kept" / "rows")
    write(folder, "b c_202112.csv", "s1,d1,W,v1,5", "s4,d1,X,v1,5")
    (folder / "d_202212.csv").write_text("tegund1,samtala2,samtala0,tegund0,raun\nt,d3,s1,W,\"2,25\"\n")
    update = kept.update(spark, str(folder))
    assert (update.taken, update.dropped) == (["b c_202112.csv", "d_202212.csv"], [])
    same(spark, kept, folder)
    # Files of other data sets were not written again.
    after = stamps(tmp_path / "kept" / "rows")
    assert {p: t for p, t in before.items() if "b%20c" not in p and "b c" not in p}.items() <= after.items()
    (folder / "c_202112.csv").unlink()
    write(folder, "a_202012.csv")
    update = kept.update(spark, str(folder))
    assert (update.taken, update.dropped) == (["a_202012.csv"], ["c_202112.csv"])
    same(spark, kept, folder)


def test_a_failed_update_leaves_the_old_rows(spark, tmp_path):
    folder, kept = tmp_path / "raw", StoredLedger(str(tmp_path / "kept"), PROFILE)
    folder.mkdir()
    write(folder, "a_202012.csv", "s1,d1,W,v1,1")
    kept.update(spark, str(folder))
    write(folder, "a_202012.csv", "s1,d1,W,v1,2", "s1,d1,W,v1,3,LOST")
    with pytest.raises(Exception, match="wider than the header"):
        kept.update(spark, str(folder))
    assert [str(r["raun"]) for r in kept.read(spark).collect()] == ["1.00"]
    write(folder, "a_202012.csv", "s1,d1,W,v1,4", "s1,d1,W,v1,4")
    kept.update(spark, str(folder))
    same(spark, kept, folder)


def test_a_data_set_of_parts_is_taken_in_whole(spark, tmp_path):
    folder, kept = tmp_path / "raw", StoredLedger(str(tmp_path / "kept"), PROFILE)
    parts = folder / "name=x_202012.csv"
    parts.mkdir(parents=True)
    write(parts, "part-0.csv", "s1,d1,W,v1,1")
    write(parts, "part-1.csv", "s1,d1,W,v1,2")
    kept.update(spark, str(folder))
    write(parts, "part-1.csv", "s1,d1,W,v1,9")
    assert kept.update(spark, str(folder)).taken == ["x_202012.csv"]
    assert sorted(str(r["raun"]) for r in kept.read(spark).collect()) == ["1.00", "9.00"]
    shutil.rmtree(parts)
    write(folder, "y_202012.csv", "s1,d1,W,v1,2")
    assert kept.update(spark, str(folder)).dropped == ["x_202012.csv"]
    same(spark, kept, folder)


def test_reports_over_cells_equal_those_over_rows(spark, sf_dir):
    rows = filters.with_departments(star_ledger(spark, sf_dir), STAR_PROFILE)
    cells = report_cells(rows, STAR_PROFILE).cache()
    for run in (
        lambda df: wages.department_report(df, STAR_PROFILE, year=1998),
        lambda df: wages.institution_report(df, STAR_PROFILE, "BUILDING"),
        lambda df: wages.wage_totals(df, STAR_PROFILE, STAR_PROFILE.department),
    ):
        assert sorted(map(str, run(cells).collect())) == sorted(map(str, run(rows).collect()))


def test_views_fall_back(spark, tmp_path):
    spark.createDataFrame([(1, " a ")], "n int, samtala2 string").write.parquet(str(tmp_path / "flagged"))
    paths = {"some": str(tmp_path / "flagged"), "every": str(tmp_path / "none"), "other": str(tmp_path / "none")}
    assert ledger.register_views(spark, paths, LedgerProfile(), {"every": "some"}) == ["some", "every"]
    assert spark.sql("SELECT samtala2_raw FROM every").first()[0] == "a"


def test_an_unknown_parent(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x")], "samtala0 string, samtala2_canonical string")
    parents = LedgerProfile().anomaly_parents
    assert filters.filter_anomalies(df, parents, parent="bogus", value="a").count() == 1
    assert filters.filter_anomalies(df, parents, parent="vm_nafn", value="a").count() == 1
