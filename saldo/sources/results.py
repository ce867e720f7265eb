"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from saldo.operators.anomalies import anomaly_summary, flagged
from saldo.settings import AnomalyConfig


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header, texts as they are. A sorted frame gives parts that are sorted from the first to the last."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_anomalies(
    scored: DataFrame, index_monthly: DataFrame, index_annual: DataFrame, folder: str, config: AnomalyConfig
) -> None:
    """All and flagged rows as Parquet and CSV, the index as CSV, and the run summary as JSON.

    The scored table is computed once; everything else is read back from its Parquet file.
    """
    spark = scored.sparkSession
    scored.write.mode("overwrite").parquet(f"{folder}/anomalies_yoy_all")
    stored = spark.read.parquet(f"{folder}/anomalies_yoy_all")
    write_csv(stored, f"{folder}/anomalies_yoy_all_csv")
    hits = flagged(stored)
    hits.write.mode("overwrite").parquet(f"{folder}/anomalies_flagged")
    write_csv(hits, f"{folder}/anomalies_flagged_csv")
    write_csv(index_monthly.orderBy("year", "month"), f"{folder}/index_monthly_csv")
    write_csv(index_annual.orderBy("year"), f"{folder}/index_annual_csv")
    summary = anomaly_summary(stored, index_annual, config)
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/anomalies_summary")
