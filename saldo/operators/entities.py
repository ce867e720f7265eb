"""Counterparty numbers to names, from captured registry pages.

Captures are two tables with the number as key: the search reply of each number and the detail
page its first detail link led to. A number without a capture is an error row.

Only pages of the asked numbers are parsed. Captures may be kept in folders by a hash of the number; then only
the folders of asked numbers are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.functions.html import page_facts
from saldo.functions.text import digits_only
from saldo.functions.urls import resolve
from saldo.operators.joins import only_new
from saldo.sources.scratch import discard, folder_exists, stored

NUMBER_COLUMNS = ("vm_number", "vm_numer")
BUCKETS = 64
#: Numbers up to which they are sent to the captures; with more, all captures are parsed.
MOST_SENT = 1_000_000


def number_column(df: DataFrame) -> str:
    for name in NUMBER_COLUMNS:
        if name in df.columns:
            return name
    raise KeyError(f"none of the columns {', '.join(NUMBER_COLUMNS)} is present")


def entity_keys(df: DataFrame, column: str | None = None, limit: int = 0) -> DataFrame:
    """Distinct numbers, digits only, in order.

    Raw values are made distinct before they are cleaned. The count keeps the two steps apart, as
    Spark would merge two plain distincts and clean every row.
    """
    source = column or number_column(df)
    present = df.select(F.col(source).alias("vm_number")).filter(F.col(source).isNotNull())
    raw = present.groupBy("vm_number").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0)
    keys = raw.select(digits_only(F.col("vm_number")).alias("vm_number"))
    keys = keys.filter(F.col("vm_number").isNotNull()).distinct().orderBy("vm_number")
    return keys.limit(limit) if limit > 0 else keys


def read_names(pages: DataFrame, *keys: str) -> DataFrame:
    """Entity name of every page, beside its key columns."""
    return pages.select(*keys, page_facts(F.col("html")).alias("facts")).select(*keys, "facts.name")


def read_search(captures: DataFrame, phrase: str, part: str) -> DataFrame:
    """What a search reply says: whether it found nothing, its detail link, and its heading.

    Pages become a few short columns here, before any join, so HTML is never shuffled.
    """
    facts = captures.select("vm_number", "url", page_facts(F.col("html"), part, phrase).alias("facts"))
    link = F.when(F.col("facts.href").isNotNull(), resolve(F.col("url"), F.col("facts.href")))
    return facts.select(
        "vm_number",
        F.col("url").alias("search_url"),
        F.col("facts.found").alias("found_nothing"),
        F.col("facts.name").alias("search_name"),
        link.alias("detail_url"),
    )


def read_detail(captures: DataFrame) -> DataFrame:
    return read_names(captures, "vm_number").select(
        "vm_number", F.lit(True).alias("has_detail"), F.col("name").alias("detail_name")
    )


def bucket_of(number: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(number), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class CaptureStore:
    """Captured pages in folders by a hash of their number."""

    path: str
    buckets: int = BUCKETS

    def add(self, captures: DataFrame) -> None:
        """Append captures ``vm_number, url, html``; each folder gets files of even size."""
        named = captures.select("vm_number", "url", "html").withColumn("bucket", bucket_of(F.col("vm_number"), self.buckets))
        named.hint("rebalance", F.col("bucket")).write.mode("append").partitionBy("bucket").parquet(self.path)

    def of(self, keys: DataFrame) -> DataFrame:
        """The captures of the folders in which the keys lie."""
        spark = keys.sparkSession
        if not folder_exists(spark, self.path):
            return spark.createDataFrame([], "vm_number string, url string, html string")
        # At most as many numbers as there are folders.
        asked = [r[0] for r in keys.select(bucket_of(F.col("vm_number"), self.buckets)).distinct().collect()]
        return spark.read.parquet(self.path).where(F.col("bucket").isin(asked)).drop("bucket")


def captures_of(source: DataFrame | CaptureStore, keys: DataFrame, count: int) -> DataFrame:
    """The captures to parse for so many keys: theirs alone, unless there are too many keys to send."""
    found = source.of(keys) if isinstance(source, CaptureStore) else source
    return found if count > MOST_SENT else found.join(F.broadcast(keys.select("vm_number")), "vm_number", "left_semi")


def classify(
    keys: DataFrame, searches: DataFrame, details: DataFrame, phrase: str, part: str, search_address: str | None = None
) -> DataFrame:
    """``vm_number, status, name, url`` for every key.

    A number without a search capture has the address that the search would have: ``search_address`` with
    the number in place of ``{number}``.
    """
    seen = keys.join(read_search(searches, phrase, part), "vm_number", "left")
    both = seen.join(read_detail(details), "vm_number", "left")
    no_search, no_detail = F.col("search_url").isNull(), F.col("has_detail").isNull()
    unlinked, nothing = F.col("detail_url").isNull(), F.col("found_nothing")
    status = (
        F.when(no_search, "error: no search capture")
        .when(nothing, "no_result")
        .when(unlinked, "result_unknown")
        .when(no_detail, "error: no detail capture")
        .when(F.col("detail_name").isNotNull(), "ok")
        .otherwise("missing_name")
    )
    name = F.when(no_search | nothing, None).when(unlinked, F.col("search_name")).otherwise(F.col("detail_name"))
    built = F.lit(None).cast("string")
    if search_address is not None:
        before, _, after = search_address.partition("{number}")
        built = F.concat(F.lit(before), F.url_encode("vm_number"), F.lit(after))
    url = F.when(no_search, built).when(nothing | unlinked, F.col("search_url")).otherwise(F.col("detail_url"))
    return both.select("vm_number", status.alias("status"), name.alias("name"), url.alias("url"))


def classify_new(
    keys: DataFrame,
    known: DataFrame,
    searches: DataFrame | CaptureStore,
    details: DataFrame | CaptureStore,
    phrase: str,
    part: str,
    search_address: str | None = None,
) -> tuple[DataFrame, int]:
    """Entity rows of the keys that are not known, and their number. Without such keys no capture is read."""
    fresh = stored(only_new(keys, known, "vm_number").select("vm_number"), "new-numbers")
    count = fresh.count()
    if not count:
        return keys.sparkSession.createDataFrame([], ENTITY_SCHEMA), 0
    found = [captures_of(source, fresh, count) for source in (searches, details)]
    return classify(fresh, *found, phrase, part, search_address), count


def resolve_new(
    keys: DataFrame,
    known: DataFrame,
    searches: DataFrame | CaptureStore,
    details: DataFrame | CaptureStore,
    phrase: str,
    part: str,
    search_address: str | None = None,
) -> DataFrame:
    """Entity rows for all keys: known ones as they are, the others classified."""
    fresh, _ = classify_new(keys, known, searches, details, phrase, part, search_address)
    kept = known.join(keys, "vm_number", "left_semi")
    return kept.select("vm_number", "status", "name", "url").unionByName(fresh)


ENTITY_SCHEMA = "vm_number string, status string, name string, url string"


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """The stored entity table; empty where nothing was stored yet."""
    return spark.read.schema(ENTITY_SCHEMA).parquet(path) if folder_exists(spark, path) else spark.createDataFrame([], ENTITY_SCHEMA)


def append_new(
    keys: DataFrame, path: str, searches: DataFrame | CaptureStore, details: DataFrame | CaptureStore, phrase: str, part: str,
    search_address: str | None = None,
) -> int:
    """Classify the numbers that the stored table lacks and append them; returns how many there were.

    The new rows are stored before they are appended, so the table is not read while it is written.
    """
    spark = keys.sparkSession
    fresh, count = classify_new(keys, read_entities(spark, path), searches, details, phrase, part, search_address)
    if count:
        rows = stored(fresh, "new-entities")
        rows.write.mode("append").parquet(path)
        discard(spark, rows)
    return count
