"""A ledger view over star-schema tables.

Dimensions are joined to the fact rows by their primary keys with left joins, which keep every
fact row exactly once. A dimension none of whose columns is asked for is therefore left out of the
plan without changing any other column. No side is hinted: small dimensions are broadcast by their
size on disk, large ones are sort-merge joined with skew handling. Small dimensions hang off the fact
rows one by one, since Spark knows the size of a file but only guesses that of a join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.functions.numbers import format_number
from saldo.settings import LedgerProfile

# Layout of the view: the wage group and the department mapping exist in the star tables.
STAR_PROFILE = LedgerProfile(
    wage_group="STANDARD",
    canonical={"HOUSEHOLD": "HOME", "FURNITURE": "HOME"},
    family={"HOUSEHOLD": "HOME / FURNITURE", "FURNITURE": "HOME / FURNITURE"},
    excluded=("MACHINERY",),
)

ORDER_COLUMNS = ("year", "period_month", "samtala0", "samtala1", "samtala2", "samtala3", "fyrirtaeki")
CUSTOMER_COLUMNS = ("samtala0", "samtala1", "samtala2", "fyrirtaeki")
INSTITUTION_COLUMNS = ("samtala0", "samtala1")
ACCOUNT_COLUMNS = ("tegund0",)
PARTY_COLUMNS = ("vm_numer", "vm_nafn")
LEDGER_COLUMNS = (
    "year", "period_month", "fyrirtaeki", "samtala0", "samtala1", "samtala2", "samtala3",
    "tegund0", "tegund1", "tegund2", "tegund3", "vm_numer", "vm_nafn", "raun",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str, wanted: set[str]) -> DataFrame:
    """Orders, with their customer where asked: that moves orders, not the more numerous lines."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        "o_custkey",
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("period_month"),
        "o_orderstatus",
    )
    if not wanted.intersection(CUSTOMER_COLUMNS):
        return orders
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"),
        F.col("c_name").alias("fyrirtaeki"),
        F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" ")).alias("samtala2"),
        "c_nationkey",
    )
    return orders.join(customers, "o_custkey", "left")


def _institutions(rows: DataFrame, spark: SparkSession, sf_dir: str, wanted: set[str]) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("samtala0"), "n_regionkey"
    )
    rows = rows.join(nations, "c_nationkey", "left")
    if "samtala1" not in wanted:
        return rows
    regions = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("samtala1")
    )
    return rows.join(regions, "n_regionkey", "left")


def _parties(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    key = F.col("n_nationkey")
    number = F.concat(F.lit("VSK-"), F.lpad(key.cast("string"), 6, "0"))
    nations = table(spark, sf_dir, "nation").select(
        key.alias("s_nationkey"),
        F.when(key != 0, number).alias("vm_numer"),
        F.when(key != 0, F.col("n_name")).alias("vm_nafn"),
    )
    return rows.join(suppliers, "l_suppkey", "left").join(nations, "s_nationkey", "left")


def star_ledger(
    spark: SparkSession, sf_dir: str, columns: Iterable[str] = LEDGER_COLUMNS, text_amounts: bool = False
) -> DataFrame:
    """Ledger rows with the asked columns.

    The amount is a decimal, as a prepared ledger stores it, or with ``text_amounts`` the text
    ``1.234,56`` of a source file. What depends on a dimension alone is computed before its join.
    """
    names = list(columns)
    wanted = set(names)
    rows = table(spark, sf_dir, "lineitem")
    if wanted.intersection(ORDER_COLUMNS):
        rows = rows.join(_orders(spark, sf_dir, wanted), "l_orderkey", "left")
    if wanted.intersection(INSTITUTION_COLUMNS):
        rows = _institutions(rows, spark, sf_dir, wanted)
    if wanted.intersection(ACCOUNT_COLUMNS):
        parts = table(spark, sf_dir, "part")
        parts = parts.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("tegund0"))
        rows = rows.join(parts, "l_partkey", "left")
    if wanted.intersection(PARTY_COLUMNS):
        rows = _parties(rows, spark, sf_dir)

    size = F.col("l_extendedprice").cast("decimal(18,2)")
    amount = F.when(F.col("l_returnflag") == "R", -size).otherwise(size)
    nothing = F.lit(None).cast("string")
    derived = {
        "samtala3": F.when(F.col("l_linenumber") != 1, F.col("o_orderstatus")),
        "tegund1": F.col("l_linestatus"),
        "tegund2": nothing,
        "tegund3": nothing,
        "raun": format_number(amount) if text_amounts else amount,
    }
    return rows.select(*[derived.get(c, F.col(c)).alias(c) for c in names])
