"""From raw documents to packed training sequences, one operator a stage.

Cases: a null, empty or letterless text has no language and goes with the first stage; a null id or source is a value like
any other; without labels of both kinds every document passes the quality stage; of rows with equal texts or of one
component the one with the smallest id stays, a null id yielding to any other; rows repeated in full go through the
first two stages alike and the third keeps one; texts of any length are read whole and cut into sequences by the last
stage only; an empty table gives an empty result; extra columns of documents are carried along up to the last stage, whatever
their names. The order of rows is not kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from saldo.llm import block_naming, language_ppm, packing, simhash_bk, site_quality
from saldo.llm.encoder import tokenizer_path
from saldo.sources.scratch import passing_folders, remove_folders, scratch_dir
from shared_folder import name_shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_ppm.keep_languages(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return site_quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return block_naming.keep_first_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_bk.keep_first_of_components(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in training sequences."""
    return packing.packed_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Statistical scores, fingerprints and packing are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again by the next.

    What a stage stored on its way is deleted when it is written, and its table when the next stage is.
    """
    name_shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES:
        path = f"{scratch_dir(spark, name)}/table"
        with passing_folders(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        remove_folders(spark, before)
        docs, before = spark.read.parquet(path), [path]
    return docs
