"""Folders of intermediate tables, and the library on the machines of a cluster."""

from __future__ import annotations

import os
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from saldo.plans.star import STAR_PROFILE
from saldo.sources import ledger
from saldo.sources.scratch import folder_exists, open_files, passing_folders, scratch_dir, stored
from saldo.sources.stored_ledger import StoredLedger


def test_passing_folders_go_with_the_block(spark):
    out = scratch_dir(spark, "out")
    with passing_folders(spark):
        held = stored(spark.range(5), "held")
        folder = held.inputFiles()[0].rsplit("/", 1)[0]
        with passing_folders(spark):
            inner = scratch_dir(spark, "inner")
            spark.range(2).write.parquet(inner)
        assert not folder_exists(spark, inner) and folder_exists(spark, folder)
        held.write.parquet(out)
    assert not folder_exists(spark, folder)
    assert spark.read.parquet(out).count() == 5


def test_passing_folders_go_when_the_block_fails(spark):
    with pytest.raises(ValueError, match="stop"), passing_folders(spark):
        folder = scratch_dir(spark, "failed")
        spark.range(2).write.parquet(folder)
        raise ValueError("stop")
    assert not folder_exists(spark, folder)
    assert stored(spark.range(3), "later").count() == 3


SETTING = "spark.sql.maxConcurrentOutputFileWriters"


def test_ledgers_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    before, seen = spark.conf.get(SETTING), []
    rows = spark.range(9000).select((F.col("id") % 45 + 1980).cast("int").alias("year"), F.lit("x").alias("source_file"), "id")
    writer = type(rows.write)
    write = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, *a, **k: seen.append(int(spark.conf.get(SETTING))) or write(self, *a, **k))
    ledger.write_ledger(rows, str(tmp_path / "ledger"))
    StoredLedger(str(tmp_path / "kept"), STAR_PROFILE)._replace(rows, "rows", ["year", "source_file"])
    assert len(seen) == 2 and min(seen) > 1 and spark.conf.get(SETTING) == before
    # More years than files that a task keeps open.
    for path in (tmp_path / "ledger", tmp_path / "kept" / "rows"):
        assert Counter(map(tuple, spark.read.parquet(str(path)).select("year", "id").collect())) == Counter((i % 45 + 1980, i) for i in range(9000))


def test_open_files_are_set_back_when_a_write_fails(spark):
    before = spark.conf.get(SETTING)
    with pytest.raises(ValueError, match="stop"), open_files(spark, 7):
        assert spark.conf.get(SETTING) == "7"
        raise ValueError("stop")
    assert spark.conf.get(SETTING) == before


def test_workers_started_elsewhere_find_the_library(tmp_path):
    """A process of its own, as the workers of this one are started in the folder of the library."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {home!r})
from saldo.session import builder, ship
spark = builder("elsewhere").master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
ship(spark)
ship(spark)
def names(batches):
    from saldo.functions.names import unique_names
    for batch in batches:
        yield batch
    assert unique_names(["a", "a"])[0] == "a"
print("rows", spark.range(3).mapInArrow(names, "id bigint").count())
spark.stop()
"""
    bare = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=bare, capture_output=True, text=True, timeout=180)
    assert "rows 3" in done.stdout, done.stderr[-2000:]
