"""The pipeline on the smallest tables, and the registered queries against their SQL."""

import pytest
from compare import difference, oracle_connection
from test_documents import brute_components

import __spark_entry__ as entry
import corpus_pipeline
from clickloom.llm import catalogue

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    assert difference(got, oracle_connection(SF_DIR).execute(entry.oracle_sql()[name]).df()) is None


def test_every_query_returns_rows(spark):
    for name in sorted(set(catalogue.QUERIES) - set(catalogue.SQL)):
        assert entry.queries()[name](spark, SF_DIR).count() > 0, name


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], SF_DIR).write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(frame.dtypes == docs.dtypes for frame in frames[:-1])
    counts = [frame.count() for frame in frames]
    assert counts[0] >= counts[1] >= counts[2] == counts[3] and counts[4] == counts[5] > 0
    before = [(r.doc_id, r.text) for r in frames[1].collect()]
    assert {r.doc_id for r in frames[2].collect()} == {doc for doc, low in brute_components(before).items() if doc == low}
    assert {r.doc_id for r in frames[4].collect()} <= {r.doc_id for r in frames[3].collect()}


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0
