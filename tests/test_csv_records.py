"""Records that span lines: cut by many tasks as the reader of whole files does."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from saldo.plans import queries
from saldo.sources import csv_folder, csv_records


@pytest.mark.parametrize(
    "line, inside, want",
    [
        (b"a,b", False, (False, False)), (b'"a,b', False, (True, False)), (b'x",c', True, (False, False)),
        (b'"a""b",""', False, (False, False)), (b'"a""', False, (True, False)), (b'a"b', False, (True, True)),
        (b'"a"b,c', False, (False, True)), (b'""""', False, (False, False)), (b'"', True, (False, False)),
        (b'","', True, (True, False)), (b'"a"\r', False, (False, False)), (b'"a" ,c', False, (False, True)), (b"", True, (True, False)),
    ],
)
def test_scan_line(line, inside, want):
    assert csv_records.scan_line(line, b",", inside) == want


def test_cut():
    W, E, M, S = csv_records.WHOLE, csv_records.END, csv_records.MIDDLE, csv_records.START
    assert list(csv_records.cut(b'a\n\n"b\nc"\n"d\ne', False, False)) == [(W, b"a"), (W, b'"b\nc"'), (S, b'"d\ne')]
    assert list(csv_records.cut(b'x\r\ny"\r\nz\r', True, True)) == [(E, b'x\ny"'), (W, b"z")]
    assert list(csv_records.cut(b"x\n\ny", True, False)) == [(M, b"x\n\ny")]
    assert list(csv_records.cut(b'"', True, False)) == [(E, b'"')]


def body(rng, newline, wild):
    def cell():
        kind = rng.random()
        if wild and kind < 0.1:
            return "".join(rng.choice('ab", \n;é') for _ in range(rng.randint(0, 6)))
        if kind < 0.5:
            return rng.choice(["", '""', "a b", "é;", "x"])
        inner = ["a", ",", "\n", '""', " ", "é", ";"] + ([newline] if newline == "\r\n" else [])
        return '"' + "".join(rng.choice(inner) for _ in range(rng.randint(0, 30))) + '"'

    width = rng.randint(1, 4)
    rows = [",".join(f"h{j}" for j in range(width))]
    rows += [",".join(cell() for _ in range(rng.choice([width, width, max(1, width - 1)]))) for _ in range(rng.randint(20, 120))]
    rows.insert(rng.randint(1, len(rows)), "")
    return newline.join(rows) + rng.choice(["", newline])


def outcome(frames, layout):
    try:
        return sum((Counter(tuple(r) for r in csv_folder.shape(f, layout.header, layout.charset, "t").collect()) for f in frames), Counter())
    except Exception as error:
        return "wider than the header" in str(error)


@pytest.mark.parametrize("wild", [False, True])
def test_fuzzed_files_read_as_by_the_whole_file_reader(spark, tmp_path, wild):
    rng = random.Random(7 + wild)
    for i in range(8):
        text = body(rng, rng.choice(["\n", "\r\n"]), wild)
        (tmp_path / f"f{i}.csv").write_bytes(text.encode("cp1252" if i % 3 == 0 else "utf-8"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "256")
    try:
        many = 0
        for layout in csv_folder.layouts(spark, str(tmp_path)):
            whole = outcome([csv_folder.read_whole(spark, [layout], True)], layout)
            frames, scratch = csv_folder.read_records(spark, [layout], 400)
            assert outcome(frames, layout) == whole, layout.path
            assert wild or len(frames) == 1
            many = max(many, scratch[0].select("block").distinct().count())
        assert many > 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_record_over_many_chunks_and_an_open_end(spark, tmp_path):
    long = "line\n" * 3000
    (tmp_path / "a.csv").write_text(f'﻿"h\n1",k\n"{long}",1\nx,2\n"open\nend')
    layout = csv_folder.FileLayout(str(tmp_path / "a.csv"), "a.csv", "utf-8", ",", ("h", "k"), True)
    frames, scratch = csv_folder.read_records(spark, [layout], 1000)
    assert scratch[0].count() > 10
    got = outcome(frames, layout)
    assert got == outcome([csv_folder.read_whole(spark, [layout], True)], layout)
    assert sorted(r["h"] for r in csv_folder.shape(frames[0], layout.header, layout.charset, "t").collect()) == sorted([long, "x", "open\nend"])


def test_names_with_pattern_characters(spark, tmp_path):
    (tmp_path / "a[1]*{x}_202005.csv").write_text('h,k\n"a\nb",1\n')
    (tmp_path / "b?_202005.csv").write_text("h,k\nc,2\n")
    ingest = csv_folder.read_csv_folder(spark, str(tmp_path))
    assert sorted((r["source_file"], r["h"]) for r in ingest.table.collect()) == [("a[1]*{x}_202005.csv", "a\nb"), ("b?_202005.csv", "c")]
    ingest.close()


def test_the_query_writes_its_texts_by_many_tasks(spark, tmp_path, monkeypatch):
    texts = [f'a "{i}",\n\nb;\n{"line\n" * (i % 50)}' for i in range(2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("source", F.lit("s"))
    rows.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(queries, "CSV_PART_BYTES", 1000, raising=False)
    folders = []
    read = csv_folder.read_csv_folder
    monkeypatch.setattr(csv_folder, "read_csv_folder", lambda spark, folder: folders.append(folder) or read(spark, folder))
    got = {r["doc_id"]: r for r in queries.csv_records(spark, str(tmp_path)).collect()}
    assert {i: r["text_sha256"] for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}
    assert {(r["source_file"], r["year"], r["period_month"]) for r in got.values()} == {("texts_202012.csv", 2020, 12)}
    parts = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folders[0])
    sizes = [r["length"] for r in parts.select("length").collect()]
    assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)
