from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from saldo.plans.star import STAR_PROFILE
from saldo.settings import LedgerProfile
from saldo.sources import csv_folder, ledger
from saldo.sources.scratch import scratch_dir
from saldo.streaming import landing


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "raw"
    root.mkdir()
    files = {
        "a_202001.csv": "﻿Ár,Samtala0,raun\n2020,Skóli,\"1.234,56\"\n2020,NA,5\n\n".encode("utf-8"),
        "b 202113.csv": "samtala0;Raun;Raun;Fjórðungur\r\nbær;1,5;x;1\r\n".encode("cp1252"),
        "c_1999.csv": b"samtala0|raun\nb\xe6r \x80 \x93q\x94|7\n",
        "d.csv": b"samtala0|raun\nb\xe6r\x81|8\n",
        "e_201912.csv": 'samtala0,raun\n"two\nlines ""quoted""",9\nplain,null\n'.encode(),
        "f_202002.csv": "Ár,Samtala0,raun\n2020,,6\n".encode("utf-8"),
        "note.txt": b"not data",
    }
    for name, body in files.items():
        (root / name).write_bytes(body)
    (root / "old").mkdir()
    (root / "old" / "z_201801.csv").write_bytes(b"samtala0,raun\nold,1\n")
    return root


def test_layouts(spark, folder):
    got = {f.name: (f.charset, f.delimiter, f.header, f.multiline) for f in csv_folder.layouts(spark, str(folder))}
    assert got == {
        "a_202001.csv": ("utf-8", ",", ("Ár", "Samtala0", "raun"), False),
        "b 202113.csv": ("cp1252", ";", ("samtala0", "Raun", "Raun", "Fjórðungur"), False),
        "c_1999.csv": ("cp1252", "|", ("samtala0", "raun"), False),
        "d.csv": ("latin-1", "|", ("samtala0", "raun"), False),
        "e_201912.csv": ("utf-8", ",", ("samtala0", "raun"), True),
        "f_202002.csv": ("utf-8", ",", ("Ár", "Samtala0", "raun"), False),
    }


def test_layouts_take_one_scan_and_sort_no_lines(spark, folder, monkeypatch):
    plans = []
    frame = type(spark.range(1))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    assert len(csv_folder.layouts(spark, str(folder))) == 6
    assert len(plans) == 1 and "Sort" not in plans[0], plans


def test_layouts_of_many_small_files_in_one_task(spark, tmp_path):
    """More files in a task than Spark holds in a map before it sorts."""
    for i in range(400):
        blank = "\n \t\n" if i % 3 == 0 else ""
        (tmp_path / f"f{i:03d}.csv").write_bytes(f"{blank}h{i},é\nx,1\n{'\"' if i % 5 == 0 else ''}z,2\n".encode("cp1252" if i % 2 else "utf-8"))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        found = csv_folder.layouts(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    got = [(f.name, f.charset, f.header, f.multiline) for f in found]
    assert got == [(f"f{i:03d}.csv", "cp1252" if i % 2 else "utf-8", (f"h{i}", "é"), i % 5 == 0) for i in range(400)]


def test_read_csv_folder(spark, folder):
    ingest = csv_folder.read_csv_folder(spark, str(folder), "now")
    df = ingest.table
    assert df.columns == [
        "source_file", "source_url", "year", "ingested_at", "period_month", "ar", "samtala0", "raun", "raun_1", "fjorungur",
    ]
    got = sorted(
        ((r["source_file"], r["year"], r["period_month"], r["samtala0"], r["raun"], r["raun_1"]) for r in df.collect()), key=str
    )
    assert got == sorted(
        [
            ("a_202001.csv", 2020, 1, "Skóli", "1.234,56", None), ("a_202001.csv", 2020, 1, None, "5", None),
            ("b 202113.csv", 2021, None, "bær", "1,5", "x"), ("c_1999.csv", 1999, None, "bær € “q”", "7", None),
            ("d.csv", None, None, "bær\x81", "8", None), ("e_201912.csv", 2019, 12, 'two\nlines "quoted"', "9", None),
            ("e_201912.csv", 2019, 12, "plain", None, None), ("f_202002.csv", 2020, 2, None, "6", None),
        ],
        key=str,
    )
    maps = dict(ingest.column_maps)
    assert list(maps) == sorted(maps) and maps["b 202113.csv"]["Raun.1"] == "raun_1"
    assert maps["a_202001.csv"]["source_file"] == "source_file" and maps["a_202001.csv"]["Ár"] == "ar"


def test_ingest_metadata(spark, folder, tmp_path):
    ingest = csv_folder.read_csv_folder(spark, str(folder), "now")
    ledger.write_metadata(ledger.ingest_metadata(spark, ingest), str(tmp_path / "meta"))
    schema = "generated_at string, file string, rows bigint, columns map<string,string>"
    got = {r["file"]: r for r in spark.read.schema(schema).json(str(tmp_path / "meta")).collect()}
    assert {f: r["rows"] for f, r in got.items()} == {
        "a_202001.csv": 2, "b 202113.csv": 1, "c_1999.csv": 1, "d.csv": 1, "e_201912.csv": 2, "f_202002.csv": 1,
    }
    assert got["d.csv"]["generated_at"] == "now" and got["a_202001.csv"]["columns"]["Ár"] == "ar"


def test_no_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        csv_folder.read_csv_folder(spark, str(tmp_path))


def test_source_columns_do_not_clash_with_provenance(spark, tmp_path):
    (tmp_path / "x_202005.csv").write_text("Year,period_month,source_file\n2001,7.0,s\n")
    (tmp_path / "y_202006.csv").write_text("raun\n1\n")
    rows = csv_folder.read_csv_folder(spark, str(tmp_path)).table.orderBy("source_file").collect()
    assert (rows[0]["year"], rows[0]["year_2"], rows[0]["period_month"], rows[0]["source_file_2"]) == (2020, "2001", "7.0", "s")
    assert (rows[1]["year"], rows[1]["period_month"]) == (2020, "6")


@pytest.mark.parametrize("line, delimiter", [("a,b;c,d", ","), ("a;b", ";"), ("a\tb\tc", "\t"), ("a|b", "|"), ("a", ","), ('"x,y,z";b', ";")])
def test_detect_delimiter(line, delimiter):
    assert csv_folder.detect_delimiter(line) == delimiter


def test_source_url(spark, tmp_path):
    files = [
        {"filename": "a.csv", "url": "u1"}, {"filename": "a.csv", "url": "u2"}, {"filename": "", "url": "u"}, {"filename": "b.csv"},
    ]
    (tmp_path / "manifest.json").write_text(json.dumps({"count": 4, "files": files}, indent=2))
    (tmp_path / "broken.json").write_text("{no json")
    manifest = ledger.read_manifest(spark, str(tmp_path / "manifest.json"))
    df = spark.createDataFrame([("a.csv", None, 1), ("b.csv", None, 2)], "source_file string, source_url string, v int")
    got = ledger.with_source_url(df, manifest)
    assert got.columns == df.columns
    assert sorted(tuple(r) for r in got.collect()) == [("a.csv", "u2", 1), ("b.csv", None, 2)]
    assert ledger.read_manifest(spark, str(tmp_path / "broken.json")).count() == 0


def test_ledger_store(spark, tmp_path):
    df = spark.createDataFrame([(2020, " HOUSEHOLD ", "1,5"), (2021, "B", "x"), (None, None, "2")], "year int, samtala2 string, raun string")
    path = str(tmp_path / "ledger")
    ledger.write_ledger(ledger.prepare_ledger(df, STAR_PROFILE), path)
    back = ledger.read_ledger(spark, path)
    assert back.filter("year is null").count() == 1
    plan = back.filter((F.col("year") == 2020) & (F.col("samtala2_canonical") == "HOME"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "EqualTo(samtala2_canonical,HOME)" in plan
    ledger.register_views(spark, {"stored_ledger": path}, LedgerProfile())
    assert spark.sql("SELECT sum(raun) FROM stored_ledger WHERE samtala2_family = 'HOME / FURNITURE'").first()[0] == 1.5


class Session:
    """Stands in for a session with or without the shared folder."""

    def __init__(self, shared, of_context=None):
        self.conf = {"spark.checkpoint.dir": shared} if shared else {}
        self.sparkContext = self
        self.getCheckpointDir = lambda: of_context


def test_scratch_follows_the_session():
    assert scratch_dir(Session("hdfs://shared/marks/"), "x").startswith("hdfs://shared/marks/x-")
    assert scratch_dir(Session(None, "hdfs://shared/of-context"), "x").startswith("hdfs://shared/of-context/x-")
    with pytest.raises(ValueError, match="shared folder"):
        scratch_dir(Session(None), "x")


def taken(rows):
    columns = sorted(c for c in rows.columns if c != "ingested_at")
    return columns, sorted((tuple(r) for r in rows.select(*columns).collect()), key=str)


def test_incremental_ingest_reads_as_the_batch_reader(spark, folder, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        landing.ingest_new(spark, str(folder), out, mark, files_per_batch=2).awaitTermination()
        return taken(landing.read_landed(spark, out))

    want = taken(csv_folder.read_csv_folder(spark, str(folder)).table)
    assert run() == want
    assert run() == want
    (folder / "g_202112.csv").write_text('period_month,raun\n"7,0","x\ny"\n')
    assert run() == taken(csv_folder.read_csv_folder(spark, str(folder)).table)
    log = {r["source_file"]: r for r in landing.read_log(spark, out).collect()}
    assert sorted(log) == [f"{n}.csv" for n in ("a_202001", "b 202113", "c_1999", "d", "e_201912", "f_202002", "g_202112")]
    assert log["g_202112.csv"]["own_month"] and log["b 202113.csv"]["columns"]["Raun.1"] == "raun_1"


def test_a_repeated_batch_adds_nothing(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    paths = sorted(str(p) for p in folder.glob("*.csv"))
    for _ in range(2):
        assert landing.commit_batch(spark, paths[:3], 0, str(folder), out, "t") == 3
        assert landing.commit_batch(spark, paths[3:], 1, str(folder), out, "t") == 3
    assert taken(landing.read_landed(spark, out)) == taken(csv_folder.read_csv_folder(spark, str(folder)).table)
    assert landing.read_log(spark, out).count() == 6
    # Only data sets of the folder itself count.
    assert landing.commit_batch(spark, [str(folder / "old" / "z_201801.csv")], 2, str(folder), out, "t") == 0


def test_incremental_ingest_loses_no_cells(spark, tmp_path):
    raw, out, mark = (tmp_path / n for n in ("raw", "out", "mark"))
    raw.mkdir()
    (raw / "a_202001.csv").write_text("a,b\n1,2\n")
    landing.ingest_new(spark, str(raw), str(out), str(mark)).awaitTermination()
    (raw / "b_202001.csv").write_text("a,b\n3,4,LOST\n")
    for _ in range(2):
        with pytest.raises(Exception, match="wider than the header"):
            landing.ingest_new(spark, str(raw), str(out), str(mark)).awaitTermination()
    rows = landing.read_landed(spark, str(out))
    assert [(r["a"], r["b"]) for r in rows.collect()] == [("1", "2")]
    (raw / "b_202001.csv").write_text("a,b\n3,4\n")
    landing.ingest_new(spark, str(raw), str(out), str(mark)).awaitTermination()
    assert sorted((r["a"], r["b"]) for r in landing.read_landed(spark, str(out)).collect()) == [("1", "2"), ("3", "4")]


def test_nothing_taken_in(spark, tmp_path):
    assert landing.read_log(spark, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        landing.read_landed(spark, str(tmp_path))


def test_blank_lines_before_the_header_are_skipped(spark, tmp_path):
    (tmp_path / "x_202005.csv").write_text("\n  \nsamtala0,raun\na,1\n\nb,2\n")
    rows = csv_folder.read_csv_folder(spark, str(tmp_path)).table
    assert sorted((r["samtala0"], r["raun"]) for r in rows.collect()) == [("a", "1"), ("b", "2")]


def test_rows_wider_than_the_header_are_an_error(spark, tmp_path):
    (tmp_path / "x_202005.csv").write_text("samtala0,raun\na,1\nb,2,lost\nshort\n")
    with pytest.raises(Exception, match="wider than the header.*x_202005.csv"):
        csv_folder.read_csv_folder(spark, str(tmp_path)).table.count()


@pytest.mark.parametrize("body", ["", "\n \n"])
def test_files_without_a_header_are_an_error(spark, tmp_path, body):
    (tmp_path / "x_202005.csv").write_text("samtala0,raun\na,1\n")
    (tmp_path / "y_202005.csv").write_text(body)
    with pytest.raises(ValueError, match="y_202005.csv"):
        csv_folder.read_csv_folder(spark, str(tmp_path))


def test_manifest_is_written_and_may_be_missing(spark, tmp_path):
    assert ledger.read_manifest(spark, str(tmp_path / "none.json")).collect() == []
    rows = spark.createDataFrame(
        [(2, 0, "http://b", "b.csv", "downloaded", 5, "tag"), (1, 3, "http://a", "a.csv", "skipped", 7, None)],
        "page_id bigint, position int, url string, filename string, status string, bytes bigint, etag string",
    )
    ledger.write_manifest(rows, str(tmp_path / "m"), "http://set", "now")
    record = spark.read.schema(ledger.MANIFEST_SCHEMA).json(str(tmp_path / "m")).first()
    assert (record["dataset_url"], record["retrieved_at"], record["count"]) == ("http://set", "now", 2)
    assert [(f["filename"], f["etag"]) for f in record["files"]] == [("a.csv", None), ("b.csv", "tag")]
    assert {r["filename"]: r["url"] for r in ledger.read_manifest(spark, str(tmp_path / "m")).collect()} == {"a.csv": "http://a", "b.csv": "http://b"}


def test_list_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("12345")
    assert [tuple(r) for r in ledger.list_files(spark, str(tmp_path)).collect()] == [("a.csv", 5)]


def test_rows_of_large_files_are_written_by_the_tasks_that_read_them(spark, tmp_path, monkeypatch):
    raw = tmp_path / "raw"
    raw.mkdir()
    for year in (2020, 2021):
        (raw / f"a_{year}01.csv").write_text("a,b\n" + "".join(f"{k},{year}\n" for k in range(2000)))
    paths = sorted(str(p) for p in raw.glob("*.csv"))

    def written(name, least):
        monkeypatch.setattr(landing, "LARGE_FILE", least)
        out = str(tmp_path / name)
        assert landing.commit_batch(spark, paths, 0, str(raw), out, "t") == 2
        return taken(landing.read_landed(spark, out)), sorted(p.parent.parent.name for p in (tmp_path / name / "rows").rglob("*.parquet"))

    assert landing.held_bytes(spark, paths) == sum(os.path.getsize(p) for p in paths)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    spark.conf.set("spark.sql.files.openCostInBytes", "8000")
    try:
        read, pieces = written("large", 1 << 10)
        moved, merged = written("small", 1 << 20)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert read == moved == taken(csv_folder.read_csv_folder(spark, str(raw)).table)
    # Each file is read in three pieces, which are written as they are; small files are brought together by year.
    assert pieces == ["year=2020"] * 3 + ["year=2021"] * 3
    assert merged == ["year=2020", "year=2021"]


def test_the_name_is_searched_once_a_row(spark, tmp_path):
    (tmp_path / "x_202005.csv").write_text("samtala0,raun\na,1\n")
    table = csv_folder.read_csv_folder(spark, str(tmp_path)).table
    assert [(r["year"], r["period_month"]) for r in table.collect()] == [(2020, 5)]
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(20\d{2})(\d{2})") == 1


def test_cells_of_windows_charset(spark):
    cells = ["plain", "", None, "þýð", "a\x80b\x99", "\x81", "€"]
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select(csv_folder.as_windows(F.col("c")).alias("c"))
    assert [r["c"] for r in rows.collect()] == ["plain", "", None, "þýð", "a€b™", "\x81", "€"]
