"""The registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare, duck

import corpus_pipeline
from saldo.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(name, spark, sf_dir):
    same, message = compare(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLE[name])
    assert same and "types differ" not in message, message


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op1_bpe_automaton", "op3_language_ppm", "op6_token_store", "op8_site_quality"])
def test_whole_tables_come_back(name, spark, sf_dir):
    out = QUERIES[name](spark, sf_dir)
    assert "CartesianProduct" not in out._jdf.queryExecution().toString()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert out.count() == docs.count() == out.join(docs, "doc_id").count()


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == docs.columns, name
        gone = {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in out.select("doc_id").collect()}
        if name in ("language_id", "quality_classifier"):
            good = [i for i in gone if i in labels and labels[i].quality == 1]
            assert len(good) <= 0.02 * docs.count(), name
        docs = out
    kept = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept
