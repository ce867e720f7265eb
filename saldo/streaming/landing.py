"""Ingest CSV files as they land, each file once, exactly as the batch reader reads them.

The stream only tells which files are new; the checkpoint remembers them. Every batch finds the layout of its own files
(charset, delimiter, header, records that span lines) and reads them as :func:`saldo.sources.csv_folder.read_csv_folder`
does, with the same rows and the same errors. Its rows go to partitions named by the batch, and then one entry a file
goes to the log. A batch that fails leaves no entry, and readers take logged batches only; a batch that runs again
replaces its own partitions and entries, so it adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from saldo.functions.periods import run_time
from saldo.sources import csv_folder
from saldo.sources.csv_folder import MONTH, PROVENANCE
from saldo.sources.scratch import folder_exists, open_files

BATCH = "batch"
#: Mean size of the files of a batch from which on their rows are written by the tasks that read them.
LARGE_FILE = 1 << 20
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
LOG_SCHEMA = "batch bigint, source_file string, path string, ingested_at string, own_month boolean, columns map<string,string>"


def landed_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the paths of new CSV files at or below a folder; no file is opened."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)
    return reader.option("maxFilesPerTrigger", files_per_batch).load(folder).select("path")


def held_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Size of the files together; none is opened."""
    found = spark.read.format("binaryFile").schema(FILE_SCHEMA).load([csv_folder.literal_path(p) for p in paths])
    return found.agg(F.sum("length")).first()[0] or 0


def commit_batch(
    spark: SparkSession, paths: list[str], batch: int, folder: str, ledger: str, ingested_at: str | None = None
) -> int:
    """Read the files of a batch, write their rows and then their log entries; returns the number of data sets.

    Files that only lie below the folder are left out, as the batch reader does.
    """
    table = spark.read.text([csv_folder.literal_path(p) for p in paths])
    files = csv_folder.table_layouts(table, folder)
    if not files:
        return 0
    ingest = csv_folder.read_csv_files(spark, files, ingested_at)
    # One type for all batches: a file may have a month of its own, which is text.
    rows = ingest.table.withColumn(MONTH, F.col(MONTH).cast("string")).withColumn(BATCH, F.lit(batch))
    # A file has one year, so a task writes as many files as it reads at the most; the rows of small files, and records that
    # were cut from their files, are brought together by year first.
    large = not ingest.scratch and held_bytes(spark, [f.path for f in files]) >= LARGE_FILE * len(files)
    spread = rows if large else rows.hint("rebalance", F.col("year"))
    writer = spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    with open_files(spark):
        writer.partitionBy("year", BATCH).parquet(f"{ledger}/rows")
    names = {f.path: dict(csv_folder.column_names(f.header)) for f in files}
    entries = [
        (batch, f.name, f.path, ingest.ingested_at, MONTH in names[f.path].values(), {c: c for c in PROVENANCE} | names[f.path])
        for f in files
    ]
    log = spark.createDataFrame(entries, LOG_SCHEMA).coalesce(1)
    log.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(f"{ledger}/log")
    ingest.close()
    return len(files)


def ingest_new(
    spark: SparkSession, folder: str, ledger: str, checkpoint: str, files_per_batch: int = 1000, ingested_at: str | None = None
) -> StreamingQuery:
    """Take in everything that has landed since the last run, each file once, then stop."""

    def commit(batch: DataFrame, number: int) -> None:
        # File names of one batch.
        paths = sorted(row["path"] for row in batch.distinct().collect())
        if paths:
            commit_batch(batch.sparkSession, paths, number, folder, ledger, ingested_at or run_time())

    stream = landed_files(spark, folder, files_per_batch)
    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, ledger: str) -> DataFrame:
    """One row a file that was taken in."""
    if not folder_exists(spark, f"{ledger}/log"):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).parquet(f"{ledger}/log")


def read_landed(spark: SparkSession, ledger: str) -> DataFrame:
    """The rows of all logged batches, with the columns of all of them; missing ones are NULL."""
    log = read_log(spark, ledger)
    logged = log.groupBy(BATCH).agg(F.bool_or("own_month").alias("own_month")).collect()
    if not logged:
        raise FileNotFoundError(f"nothing has been taken in at {ledger}")
    rows = spark.read.option("mergeSchema", True).parquet(f"{ledger}/rows").where(F.col(BATCH).isin([r[BATCH] for r in logged]))
    # The month is a number unless some file has one of its own, as the batch reader has it.
    month = F.col(MONTH) if any(r["own_month"] for r in logged) else F.col(MONTH).cast("int")
    columns = [c for c in rows.columns if c not in (*PROVENANCE, MONTH, BATCH)]
    return rows.withColumn(MONTH, month).select(*PROVENANCE, MONTH, *columns)
