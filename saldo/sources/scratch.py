"""Where intermediate tables may be written."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Folders named inside the innermost ``passing_folders``.
_NAMED: ContextVar[list[str] | None] = ContextVar("named", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    There is no fall-back: a folder of one machine would lose rows on a cluster.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        raise ValueError("name a shared folder in spark.checkpoint.dir or with SparkContext.setCheckpointDir")
    return shared.rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder."""
    folder = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    named = _NAMED.get()
    if named is not None:
        named.append(folder)
    return folder


@contextmanager
def passing_folders(spark: SparkSession) -> Iterator[None]:
    """Deletes the folders that are named inside, when the block ends or fails.

    Operators return frames that read their intermediate tables later on; written inside this block to a folder
    named outside of it, a result needs them no longer.
    """
    token = _NAMED.set([])
    try:
        yield
    finally:
        jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
        for folder in _NAMED.get() or []:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)
        _NAMED.reset(token)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame written once and read back, for results that several later steps read.

    Lineage ends at the written files, so a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark, label)}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Files that a task which writes by partition keeps open; together they hold rows of that task only.
OPEN_FILES = 32


@contextmanager
def open_files(spark: SparkSession, number: int = OPEN_FILES) -> Iterator[None]:
    """Inside, tasks that write by partition keep so many files open, and sort rows only from one more partition on.

    Otherwise Spark sorts all rows of a task by partition first, in memory many times the size of the rows as shuffled.
    """
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(number))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in whatever store it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _plain(path: str) -> str:
    """A path with one way to write a local file."""
    return re.sub("^file:/*(?=/)", "", path)


def remove_folders(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete folders, named as Spark lists them, with all they hold."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        # Listed names are encoded addresses.
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(hadoop).delete(path, True)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of stored frames that nothing reads any more; files outside the shared folder stay."""
    root = _plain(shared_folder(spark)) + "/"
    found = {name.rsplit("/", 1)[0] for frame in frames for name in frame.inputFiles()}
    remove_folders(spark, [folder for folder in found if _plain(folder).startswith(root)])
