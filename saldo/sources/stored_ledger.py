"""A ledger kept up to date file by file, with the partial sums that the wage reports need.

Rows lie in partitions of year and source file, so a changed file replaces its own rows and nothing else is rewritten.
Beside them lie sums: for each file one row a cell, which is all that a report tells apart. Sums of sums are sums,
so reports over the cells equal those over the rows, and a changed file costs its own cells only.

A log remembers size and time of every file that was taken in. It is written last: a run that fails before leaves the old
entries, and the next run takes the same files again, which replaces their partitions by the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.functions.numbers import to_month
from saldo.operators.wages import ROWS
from saldo.settings import LedgerProfile
from saldo.sources import csv_folder, ledger
from saldo.sources.scratch import folder_exists, open_files, remove_folders

FILE = "source_file"
LOG_SCHEMA = "path string, length bigint, modified timestamp, source_file string"


@dataclass(frozen=True)
class Update:
    """Data sets that were taken in, new or changed, and those that were dropped as their files are gone."""

    taken: list[str]
    dropped: list[str]


def report_cells(rows: DataFrame, profile: LedgerProfile) -> DataFrame:
    """Rows summed to what reports tell apart, in the columns of the ledger; ``_rows`` is how many they were.

    The month of a cell is its latest, as reports ask for the latest month of a year.
    """
    wanted = [FILE, profile.year, profile.institution, profile.department, profile.account_group, *profile.detail]
    keys = [c for c in dict.fromkeys(wanted) if c in rows.columns]
    figures = [F.sum(profile.measure).alias(profile.measure), F.count(F.lit(1)).alias(ROWS)]
    if profile.month in rows.columns:
        figures.append(F.max(to_month(F.col(profile.month))).alias(profile.month))
    return rows.groupBy(*keys).agg(*figures)


@dataclass(frozen=True)
class StoredLedger:
    path: str
    profile: LedgerProfile = field(default_factory=LedgerProfile)

    def _table(self, name: str) -> str:
        return f"{self.path}/{name}"

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows, with the columns of all files."""
        return spark.read.option("mergeSchema", True).parquet(self._table("rows"))

    def cells(self, spark: SparkSession) -> DataFrame:
        """The partial sums of all files; the reports of ``saldo.operators.wages`` take them in place of rows."""
        return spark.read.option("mergeSchema", True).parquet(self._table("cells"))

    def log(self, spark: SparkSession) -> DataFrame:
        path = self._table("log")
        return spark.read.schema(LOG_SCHEMA).parquet(path) if folder_exists(spark, path) else spark.createDataFrame([], LOG_SCHEMA)

    def update(self, spark: SparkSession, folder: str, ingested_at: str | None = None) -> Update:
        """Take in the files of a folder that are new or changed, and drop the rows of those that are gone.

        A data set of several part files is taken in whole when one of them changes. File names reach the driver.
        """
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(folder)
        listed = {r["path"]: (r["length"], r["modificationTime"]) for r in found.select("path", "length", "modificationTime").collect()}
        names = {path: csv_folder.data_set(path, folder) for path in listed}
        listed = {path: seen for path, seen in listed.items() if names[path]}
        logged = {r["path"]: r for r in self.log(spark).collect()}
        before: dict[str, set] = {}
        for path, r in logged.items():
            before.setdefault(r[FILE], set()).add((path, r["length"], r["modified"]))
        now: dict[str, set] = {}
        for path, seen in listed.items():
            now.setdefault(names[path], set()).add((path, *seen))
        taken = sorted(name for name, files in now.items() if before.get(name) != files)
        dropped = sorted(set(before) - set(now))
        if taken:
            self._take(spark, folder, [(path, *listed[path], name) for path in sorted(listed) if (name := names[path]) in taken], ingested_at)
        for name in ("rows", "cells", "log") if dropped else ():
            self._drop(spark, name, dropped)
        return Update(taken, dropped)

    def _take(self, spark: SparkSession, folder: str, entries: Sequence[tuple], ingested_at: str | None) -> None:
        table = spark.read.text([csv_folder.literal_path(path) for path, *_ in entries])
        ingest = csv_folder.read_csv_files(spark, csv_folder.table_layouts(table, folder), ingested_at)
        month = self.profile.month
        typed = ingest.table.withColumn(month, F.col(month).cast("string"))
        rows = ledger.prepare_ledger(typed, self.profile).hint("rebalance", F.col("year"), F.col(FILE))
        names = {name for *_, name in entries}
        self._replace(rows, "rows", ["year", FILE])
        # A file without rows writes no partition, so those that it had are dropped.
        emptied = names - {r[FILE] for r in ingest.table.select(FILE).distinct().collect()}
        for name in ("rows", "cells") if emptied else ():
            self._drop(spark, name, emptied)
        cells = report_cells(self._of(spark, "rows", names - emptied), self.profile)
        self._replace(cells.hint("rebalance", F.col(FILE)), "cells", [FILE])
        self._replace(spark.createDataFrame(entries, LOG_SCHEMA).coalesce(1), "log", [FILE])
        ingest.close()

    def _replace(self, rows: DataFrame, name: str, keys: Sequence[str]) -> None:
        """Write rows over the partitions that they belong to; the others stay."""
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        with open_files(rows.sparkSession):
            writer.partitionBy(*keys).parquet(self._table(name))

    def _of(self, spark: SparkSession, name: str, files: Iterable[str]) -> DataFrame:
        return spark.read.option("mergeSchema", True).parquet(self._table(name)).where(F.col(FILE).isin(sorted(files)))

    def _drop(self, spark: SparkSession, name: str, files: Iterable[str]) -> None:
        if not folder_exists(spark, self._table(name)):
            return
        # Folders of the dropped files only, as far as they hold rows.
        held = self._of(spark, name, files).select(F.col("_metadata.file_path").alias("path")).distinct().collect()
        remove_folders(spark, {row["path"].rsplit("/", 1)[0] for row in held})
