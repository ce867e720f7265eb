"""File links on catalogue pages, and the manifest of what was fetched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions.urls import file_name, links
from saldo.operators.ordering import first_seen

# Links to CSV files below a download path.
CSV_LINK = 'href="([^"]+download/[^"]+\\.csv)"'


def harvest_links(pages: DataFrame, pattern: str = CSV_LINK, key: str = "page_id") -> DataFrame:
    """Distinct links of every page with their position on it and their file name."""
    found = links(F.col("html"), F.col("url"), pattern)
    rows = pages.select(key, F.posexplode(found).alias("position", "link"))
    return rows.withColumn("filename", file_name(F.col("link")))


def first_pages(harvested: DataFrame, key: str = "page_id") -> DataFrame:
    """Every link once, with the first page that has it."""
    return first_seen(harvested, "link", key)


def _listing(files: DataFrame, name: str) -> DataFrame:
    return files.groupBy("filename").agg(F.max("bytes").alias(name))


def manifest(
    harvested: DataFrame,
    before: DataFrame,
    after: DataFrame,
    force: bool = False,
    order: Sequence[str] = ("page_id", "position"),
) -> DataFrame:
    """Status and size per link, from the file listings before and after the fetch.

    A file that was there before is skipped (unless ``force``), one that has landed since was
    downloaded, and anything else is an error of zero bytes. When several links lead to one file
    name, the first in ``order`` fetches it and the others find it there.
    """
    rank = F.struct(*order)
    firsts = harvested.groupBy("filename").agg(F.min(rank).alias("_first"))
    files = firsts.join(_listing(before, "_had"), "filename", "left").join(_listing(after, "_has"), "filename", "left")
    joined = harvested.withColumn("_rank", rank).join(files, "filename", "left")
    landed = F.col("_has").isNotNull()
    skipped = F.lit(False) if force else F.col("_had").isNotNull() | (landed & (F.col("_rank") != F.col("_first")))
    status = F.when(skipped, "skipped").when(landed, "downloaded").otherwise("error: file has not landed")
    size = F.when(skipped, F.coalesce("_had", "_has")).otherwise(F.coalesce("_has", F.lit(0)))
    return joined.select(
        *order, F.col("link").alias("url"), "filename", status.alias("status"), size.cast("bigint").alias("bytes")
    )


def is_error(status: Column) -> Column:
    return status.startswith("error")


def manifest_summary(rows: DataFrame) -> DataFrame:
    """One row: number of links, errors and bytes."""
    return rows.agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(is_error(F.col("status"))).alias("errors"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )
