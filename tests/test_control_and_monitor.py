from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallywatch.operators import control, monitor

START = datetime(2024, 1, 1)


def test_batch_counts_and_status(spark):
    rows = [("b", "FRAUD_ALERT", "a1", "COMPLETED"), ("b", "FRAUD_ALERT", "a2", "PARTIAL"), ("b", "FRAUD_ALERT", "a3", "FAILED"),
            ("b", "LOW_RISK", None, "NOT_APPLICABLE"), ("b", "PENDING", None, "PENDING")]
    df = spark.createDataFrame(rows, "batch_id string, processing_status string, alert_id string, investigation_status string")
    row = control.batch_counts(df).first()
    assert (row["investigations_succeeded"], row["investigations_partial"], row["investigations_failed"]) == (1, 1, 1)
    assert (row["investigations_completed"], row["processed"], row["investigations_pending"]) == (2, 4, 0)
    batches = spark.createDataFrame([(False, 3, 3, 0), (False, 1, 3, 2), (False, 0, 3, 0), (True, 3, 3, 0)],
                                    "cancelled boolean, sent_count int, requested_count int, failed_count int")
    got = [r[0] for r in batches.select(control.final_batch_status(F.col("cancelled"))).collect()]
    assert got == ["COMPLETED", "PARTIAL", "FAILED", "CANCELLED"]
    progress = batches.select(control.progress_pct(F.col("sent_count"), F.col("requested_count"))).collect()
    assert [r[0] for r in progress] == [100.0, 33.3, 0.0, 100.0]


def test_empty_tables_give_zero_summary(spark):
    batches = spark.createDataFrame([], "requested_count int, generated_count int, sent_count int, failed_count int")
    tx = spark.createDataFrame([], "processing_status string, alert_id string, investigation_status string")
    assert set(control.global_summary(batches, tx).first()) == {0}


def test_requests_with_and_without_keys(spark):
    rows = [(1, "k", "h", 1), (2, "k", "h", 2), (3, "k", "other", 3), (4, None, "h", 4)]
    df = spark.createDataFrame(rows, "request_id int, idempotency_key string, request_hash string, requested_at int")
    got = {r["request_id"]: (r["outcome"], r["effective_request_id"]) for r in control.batch_requests(df).collect()}
    assert got == {1: ("created", 1), 2: ("existing", 1), 3: ("conflict", 1), 4: ("created", 4)}
    assert control.conflicting_keys(df).first()["bodies"] == 2


def test_pending_defaults(spark):
    tx = spark.createDataFrame([("t", "a", "PENDING"), ("u", "b", "PENDING"), ("v", None, "NOT_APPLICABLE")],
                               "transaction_id string, alert_id string, investigation_status string")
    results = spark.createDataFrame([("a", 1, "i1", "completed"), ("a", 2, "i2", None)],
                                    "alert_id string, generated_at int, investigation_id string, investigation_status string")
    got = {r["transaction_id"]: (r["investigation_status"], r["investigation_id"]) for r in control.update_pending(tx, results).collect()}
    assert got == {"t": ("FAILED", "i2"), "u": ("PENDING", None), "v": ("NOT_APPLICABLE", None)}


def test_page_order_and_total(spark):
    df = spark.range(60).select(F.concat(F.lit("t"), "id").alias("transaction_id"), (F.col("id") % 5).cast("double").alias("amount"),
                                F.col("id").alias("sequence_number"), F.lit("x").alias("generated_at"))
    items, total = control.ledger_page(df, F.col("amount") > 0, page=2, page_size=10, sort_by="amount", descending=False)
    rows = items.collect()
    assert total == 48 and [r["amount"] for r in rows] == [1.0] * 2 + [2.0] * 8
    assert [r["sequence_number"] for r in rows[:2]] == [51, 56]


def minutes(spark, values, start=START):
    return spark.createDataFrame([(start + timedelta(minutes=m), v) for m, v in values], "minute timestamp, active boolean")


def test_rule_fires_after_it_held(spark):
    states = minutes(spark, [(0, True), (1, True), (2, True), (3, False), (4, True), (5, True), (7, True)])
    got = monitor.firing_spans(states, [], "active", hold=2).collect()
    assert [(r["active_since"], r["firing_from"], r["active_until"]) for r in got] == [
        (START, START + timedelta(minutes=2), START + timedelta(minutes=2))]
    assert monitor.firing_spans(states, [], "active", hold=0).count() == 3


def test_silence_needs_a_full_window(spark):
    df = spark.createDataFrame([(START,), (START + timedelta(minutes=25),)], "ts timestamp")
    got = sorted(r["minute"] for r in monitor.silent_minutes(df).collect())
    assert got == [START + timedelta(minutes=m) for m in range(10, 25)]


def test_counter_resets(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([5, 8, 8, 2, 3, 0])], "s string, t int, c long")
    got = [r["increase"] for r in monitor.counter_increase(df, ["s"], "c", "t", F.floor(F.col("t") / 2)).orderBy("t").collect()]
    assert got == [None, 3, 0, 2, 1, 0]


@pytest.mark.parametrize("counts,share,want", [
    ({1.0: 10, 2.5: 0, float("inf"): 0}, 0.5, 0.5), ({1.0: 5, 2.5: 5}, 0.75, 1.75), ({1.0: 1, float("inf"): 99}, 0.95, 5.0)])
def test_histogram_quantile(spark, counts, share, want):
    df = spark.createDataFrame([("s", le, n) for le, n in counts.items() if n], "s string, le double, n long")
    got = monitor.histogram_quantile(df, share, ["s"], [1.0, 2.5, 5.0]).first()["quantile"]
    assert got == pytest.approx(want)


def test_ratio_floor(spark):
    df = spark.createDataFrame([(START, "ok")], "ts timestamp, status string")
    row = monitor.status_ratio(df, F.col("status") == "ok").first()
    assert row["ratio"] == pytest.approx(1.0)
    assert monitor.failure_share(df, F.col("status") == "bad", []).first()["share"] == 0.0
