"""The streaming decision job: replay, half-done batches, trained models, and state taken over from a batch."""

from __future__ import annotations

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tallywatch.operators.behavior import _FEATURES, behavioral_features
from tallywatch.operators.route import assign_tiers, decide
from tallywatch.sources import readers
from tallywatch.streaming import decisions, router, stateful
from tests.models import frame, transaction


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="tallywatch-test-")


def decider(rows):
    return decide(assign_tiers(rows.withColumns({
        "anomaly_score": F.round(F.col("log_amount") * 0.03 - 0.1, 6), "second_stage_probability": F.when(F.col("type") == "TRANSFER", 0.9).otherwise(0.1)})))


def events(spark, n=60):
    draw = random.Random(6)
    rows = [transaction(i, 1 + i // 3, target=f"M{draw.randint(0, 3)}") for i in range(n)]
    df = frame(spark, rows).withColumns({"oldbalanceDest": F.lit(0.0), "newbalanceDest": F.col("amount")})
    return df.withColumn("transaction_id", F.concat(F.lit("t"), F.col("event_id").cast("string"))).withColumn(
        "amount", F.when(F.col("event_id") % 10 == 4, -1.0).otherwise(F.col("amount")))


def run_job(spark, folder, df):
    stateful.use_rocksdb(spark)
    df.coalesce(1).write.parquet(f"{folder}/in")
    stream = decisions.feature_stream(readers.file_events(spark, f"{folder}/in", df.schema))
    decisions.start_decisions(stream, decider, folder, f"{folder}/checkpoint", available_now=True).awaitTermination()


def test_job_equals_batch_and_replay_changes_nothing(spark, folder):
    from tallywatch.operators.features import base_features
    from tallywatch.operators.validate import validate_transactions

    df = events(spark)
    run_job(spark, folder, df)
    names = ["event_id", "risk_level", "final_prediction", "final_decision_path", *_FEATURES]
    want = decider(base_features(behavioral_features(validate_transactions(df), order="event_id"))).select(*names)
    read = lambda: sorted(map(tuple, decisions.committed(spark, folder, "decisions").select(*names).collect()))
    assert read() == sorted(map(tuple, want.collect()))
    ledger = spark.read.parquet(f"{folder}/ledger").drop("micro_batch").collect()
    bad = df.where("event_id % 10 = 4").count()
    assert sum(r["records"] for r in ledger) == 60 and sum(r["rejects"] for r in ledger) == bad
    assert sum(r["total"] for r in ledger) == sum(r["direct_alerts"] + r["second_stage_alerts"] + r["low_risk"] for r in ledger) == 60 - bad
    assert decisions.committed(spark, folder, "rejects").count() == bad
    messages = decisions.committed(spark, folder, "messages").count()
    # The same batch once more, from its rows.
    batch = base_features(behavioral_features(validate_transactions(df), order="event_id")).withColumn("violations", F.lit(None).cast("array<string>"))
    number = spark.read.parquet(f"{folder}/ledger").agg(F.max("micro_batch")).first()[0]
    before = read()
    decisions.decision_batch(decider, folder)(batch, number)
    assert read() == before and decisions.committed(spark, folder, "messages").count() == messages


def test_half_done_batch_is_not_shown(spark, folder):
    df = events(spark, 12)
    run_job(spark, folder, df)
    shown = decisions.committed(spark, folder, "decisions").count()
    router.write_batch(spark.read.parquet(f"{folder}/decisions").drop("micro_batch"), f"{folder}/decisions", 99, "route")
    assert decisions.committed(spark, folder, "decisions").count() == shown < spark.read.parquet(f"{folder}/decisions").count()


def test_batch_without_good_rows(spark, folder):
    run_job(spark, folder, events(spark, 12).withColumn("amount", F.lit(-5.0)))
    ledger = spark.read.parquet(f"{folder}/ledger").agg(F.sum("records"), F.sum("rejects"), F.sum("total")).first()
    assert tuple(ledger) == (12, 12, 0)


@pytest.mark.parametrize("gap_mode", ["retained", "last"])
def test_stream_goes_on_from_batch_history(spark, folder, gap_mode):
    draw = random.Random(2)
    df = frame(spark, [transaction(i, 1 + i // 4, target=f"M{draw.randint(0, 5)}") for i in range(200)])
    early, late = df.where("step <= 25"), df.where("step > 25")
    stateful.use_rocksdb(spark)
    stateful.state_history(early).write.parquet(f"{folder}/history")
    late.coalesce(1).write.parquet(f"{folder}/in")
    stream = stateful.behavioral_stream(readers.file_events(spark, f"{folder}/in", df.schema), gap_mode=gap_mode, history=spark.read.parquet(f"{folder}/history"))
    query = stream.writeStream.foreachBatch(lambda rows, n: router.write_batch(rows, f"{folder}/rows", n)).outputMode("update")
    query.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = {r["event_id"]: r for r in spark.read.parquet(f"{folder}/rows").collect()}
    want = behavioral_features(df, order="event_id", gap_mode=gap_mode).where("step > 25").collect()
    assert len(got) == len(want) > 50
    for row in want:
        for name in _FEATURES:
            assert got[row["event_id"]][name] == pytest.approx(row[name], abs=1e-9), name
