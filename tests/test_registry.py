from __future__ import annotations

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["routed_decision_counts", "ranking_metrics", "account_profiles", "ledger_page", "nearest_vectors"])
def test_results_equal_the_sql(spark, name):
    duck = duckdb.connect()
    for table in ("events", "documents", "labels", "embeddings", "orders", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = duck.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def rows(df):
        return sorted(map(str, df[columns].astype(object).itertuples(index=False, name=None)))

    assert rows(got) == rows(want)


def test_no_local_checkpoint_and_no_cross_join():
    for path in (ROOT / "tallywatch").rglob("*.py"):
        text = path.read_text()
        assert not re.search(r"localCheckpoint|crossJoin|\.rdd\b", text), path
