"""The pipeline and the registered queries on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from tallywatch.llm import queries

DATA = "/root/testdata/sf0.001"


def test_every_stage_keeps_what_it_should(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, DATA).cache()
        now = {r.doc_id: r.text for r in result.collect()}
        assert len(now) == result.count() and set(now) <= set(before), name
        if name == "quality classifier":
            assert all(labels.get(i) != 1 for i in set(before) - set(now))
        if name in ("secrets", "encoding"):
            assert set(now) == set(before)
        if name == "encoding":
            assert now == {i: t or "" for i, t in before.items()}
        else:
            assert result.columns == docs.columns
            docs = result
        before = now


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    found = queries.QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name])
    assert sorted(found.columns) == sorted(want.columns)
    order = sorted(found.columns)
    assert sorted(map(str, map(tuple, found.select(*order).collect()))) == sorted(map(str, want.select(*order).fetchall()))
