"""A shared folder for sessions that others set up without one, as in local tests and benches."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def name_shared_folder(spark: SparkSession) -> None:
    """Leave a named folder alone; on a one-machine session without one, name a temporary folder."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(f"file://{folder}")
