"""The registered queries against their SQL, and the pipeline over the small tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from plumbline.llm import ORACLES, QUERIES
from plumbline.llm.packing import LENGTH
from tests.oracle_check import connect, differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    assert differences(spark, connect(small), QUERIES[name], ORACLES[name], small) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_covers_the_table(spark, small, name):
    got = QUERIES[name](spark, small)
    table, key = ("embeddings", "vec_id") if "vec_id" in got.columns else ("documents", "doc_id")
    whole = spark.read.parquet(f"{small}/{table}.parquet")
    assert got.select(key).distinct().count() == whole.count()


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == columns, name
        if name != "mixing":
            assert 0 < docs.count() <= count, name
            count = docs.count()
    pieces = corpus_pipeline.run(spark, small)
    assert pieces.filter(f"length > {LENGTH}").count() == 0
    assert pieces.filter("piece = 0").count() == docs.count()
