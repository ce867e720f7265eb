"""The ledger table: provenance, storage and named views."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.functions.numbers import measure as amount_of
from saldo.operators.filters import with_departments
from saldo.settings import LedgerProfile
from saldo.sources.csv_folder import Ingest
from saldo.sources.scratch import folder_exists, open_files

MANIFEST_SCHEMA = """
    dataset_url string, retrieved_at string, count bigint,
    files array<struct<url: string, filename: string, status: string, bytes: bigint,
                       etag: string, last_modified: string>>
"""


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """File name and address of every entry; a missing or broken manifest has none. The last entry wins."""
    if not folder_exists(spark, path):
        return spark.createDataFrame([], "filename string, url string")
    files = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
    rows = files.select(F.posexplode("files").alias("position", "file")).select("position", "file.filename", "file.url")
    usable = rows.filter((F.col("filename") != "") & (F.col("url") != ""))
    return usable.groupBy("filename").agg(F.max_by("url", "position").alias("url"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Name and size of every file in a folder; no file is opened."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.substring_index("path", "/", -1).alias("filename"), F.col("length").alias("bytes"))


def write_manifest(rows: DataFrame, path: str, dataset_url: str, retrieved_at: str) -> None:
    """One JSON record of what was fetched, from rows of ``harvest.manifest`` in the order of their links.

    ``etag`` and ``last_modified`` are taken where the rows have them. A manifest lists files, so one record holds it.
    """
    extra = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("etag", "last_modified")]
    order = [c for c in ("page_id", "position") if c in rows.columns]
    entry = F.struct("url", "filename", "status", F.col("bytes").cast("bigint").alias("bytes"), *extra)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, entry.alias("entry")))), lambda x: x["entry"])
    record = rows.agg(F.count(F.lit(1)).alias("count"), listed.alias("files"))
    head = record.select(F.lit(dataset_url).alias("dataset_url"), F.lit(retrieved_at).alias("retrieved_at"), "count", "files")
    head.write.mode("overwrite").json(path)


def with_source_url(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """Fill ``source_url`` by file name; NULL where the manifest does not list the file.

    No hint: Spark broadcasts the manifest when its measured size allows it.
    """
    urls = manifest.select(F.col("filename").alias("source_file"), F.col("url").alias("_url"))
    joined = df.join(urls, "source_file", "left").withColumn("source_url", F.col("_url"))
    return joined.select(*df.columns)


def prepare_ledger(df: DataFrame, profile: LedgerProfile) -> DataFrame:
    """Parse the measure once and store the department columns, so that filters on them reach the scan."""
    typed = df.withColumn(profile.measure, amount_of(df, profile.measure, profile.scale, profile.precision))
    return with_departments(typed, profile)


def write_ledger(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by year. The rebalance evens out file sizes, splitting years that hold many rows."""
    with open_files(df.sparkSession):
        df.hint("rebalance", F.col("year")).write.mode(mode).partitionBy("year").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ingest_metadata(spark: SparkSession, ingest: Ingest) -> DataFrame:
    """One row per file: run time, row count, and the map from original to final column names."""
    maps = spark.createDataFrame(ingest.column_maps, "file string, columns map<string,string>")
    counts = ingest.table.groupBy(F.col("source_file").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    rows = F.coalesce("n", F.lit(0)).alias("rows")
    return maps.join(counts, "file", "left").select(
        F.lit(ingest.ingested_at).alias("generated_at"), "file", rows, "columns"
    )


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata.write.mode("overwrite").json(path)


def register_views(
    spark: SparkSession, paths: Mapping[str, str], profile: LedgerProfile, instead: Mapping[str, str] | None = None
) -> list[str]:
    """A named view with department columns over each stored table; returns the names.

    ``instead`` names, for a table that may be absent, the one to show in its place: the flagged anomalies where the full
    table was not kept. Without either there is no view.
    """
    made = []
    for name, path in paths.items():
        if not folder_exists(spark, path):
            path = paths.get((instead or {}).get(name, ""))
            if path is None or not folder_exists(spark, path):
                continue
        table = spark.read.parquet(path)
        mapped = table if profile.department in table.columns else with_departments(table, profile)
        mapped.createOrReplaceTempView(name)
        made.append(name)
    return made
