"""The registered query of each operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.llm import (
    ball_codes, bit_sliced_resampling, block_naming, bpe_automaton, language_ppm, line_index, packing, simhash_bk, site_quality,
    token_store, url_trees, vector_tree, warc,
)
from saldo.llm.encoder import tokenizer_path
from saldo.llm.oracle import OP11, OP12, OP13
from saldo.sources.scratch import scratch_dir


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    decoded = bpe_automaton.encode_and_decode(_documents(spark, sf_dir), path)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op3_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    model = language_ppm.fit(docs.where(~F.coalesce("held_out", F.lit(False))))
    found = language_ppm.predict_column(spark, model, F.col("text"))
    return docs.select("doc_id", "held_out", found.alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")


#: The rules that decide before the judge does.
URL_RULES = [
    url_trees.Rule("block", "net", "/"),
    url_trees.Rule("allow", "example.net", "/en/"),
    url_trees.Rule("block", "example.com", "/de/"),
    url_trees.Rule("allow", "org", "/fr/"),
]


def op4_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled are the URLs whose document, named by the number in the path, has a label: bad if poor or toxic."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    named = pages.withColumn("doc_id", F.expr("try_cast(regexp_extract(url, '/([0-9]+)[^/0-9]*/?(?:[?#].*)?$', 1) AS BIGINT)"))
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad")
    labelled = named.join(labels, "doc_id").select("url", bad)
    judged = url_trees.judge(pages, labelled, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "bad_probability")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.near_duplicates(_documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "tokens")
    manifest = token_store.write_tokens(_documents(spark, sf_dir), folder, tokenizer_path("word_bpe_49k.json"))
    return token_store.read_tokens(spark, manifest).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "warc")
    warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    responses = warc.read_warc(spark, folder).where("record_type = 'response'")
    # Revisits are read from their headers alone.
    revisits = warc.read_warc(spark, folder, payload=False).where("record_type = 'revisit'")
    return responses.select("page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"), "payload_digest", "record_type", "refers_to").unionByName(
        revisits.select("page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    )


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = site_quality.score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.drop("mark").withColumn("kept", F.col("quality") >= site_quality.LEAST_QUALITY)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_duplicates(_documents(spark, sf_dir)).drop("mark")


def op10_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = rows.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"))
    return vector_tree.nearest(rows, queries)


def op11_bit_sliced_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced_resampling.resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_index.drop_common_lines(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = ball_codes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = F.lit(books.sha256() if books else None).cast("string")
    return ball_codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_automaton": op1_bpe_automaton,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_ppm": op3_language_ppm,
    "op4_url_trees": op4_url_trees,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_token_store": op6_token_store,
    "op7_warc": op7_warc,
    "op8_site_quality": op8_site_quality,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_vector_tree": op10_vector_tree,
    "op11_bit_sliced_resampling": op11_bit_sliced_resampling,
    "op12_line_index": op12_line_index,
    "op13_ball_codes": op13_ball_codes,
}

ORACLE: dict[str, str] = {
    "op9_exact_dedup": r"""
WITH plain AS (
  SELECT doc_id, coalesce(text, '') AS whole, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER best = 1 AS kept,
       sha256(body) AS text_sha256
FROM plain
WINDOW best AS (PARTITION BY body ORDER BY length(whole) DESC, doc_id)
""",
    "op11_bit_sliced_resampling": OP11,
    "op12_line_index": OP12,
    "op13_ball_codes": OP13,
}
