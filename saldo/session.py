"""Session settings for large runs."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Partition counts follow the measured size: start wide, merge small ones, split hot ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000",
    "spark.sql.files.maxPartitionBytes": "256m",
    # Sides are broadcast by size only, at plan time and again with the sizes seen at run time.
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
}


def builder(app: str) -> SparkSession.Builder:
    """A session builder with the settings above; the cluster adds master, memory and folders."""
    out = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        out = out.config(key, value)
    return out


def ship(spark: SparkSession) -> None:
    """Send the library to the executors, once for each context, where it is not installed on them.

    The archive is made in a folder of the driver; Spark hands it out.
    """
    context = spark.sparkContext
    if any(name.endswith("/saldo.zip") for name in context.listFiles):
        return
    # Executors fetch it from the driver when they first need it, so it stays as long as the driver.
    folder = tempfile.mkdtemp(prefix="run-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "saldo.zip")
    with zipfile.PyZipFile(path, "w") as archive:
        # Compiled modules, as workers cannot keep what they compile from an archive.
        archive.writepy(os.path.dirname(os.path.abspath(__file__)))
    context.addPyFile(path)
