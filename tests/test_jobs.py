from __future__ import annotations

import json
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywatch.operators import cascade, forest
from tallywatch.operators.behavior import _FEATURES
from tallywatch.sources import readers, writers
from tallywatch.streaming import router, stateful
from tests.models import frame, sequential_behavior, transaction


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="tallywatch-test-")


def write_steps(spark, rows, path, batches):
    """One file per batch, in step order."""
    rows = sorted(rows, key=lambda r: (r["step"], r["event_id"]))
    size = -(-len(rows) // batches)
    for at in range(0, len(rows), size):
        frame(spark, rows[at:at + size]).coalesce(1).write.mode("append").parquet(path)
    return frame(spark, rows).schema


def run_stream(spark, stream, folder, mode="update"):
    query = (stream.writeStream.foreachBatch(lambda df, n: router.write_batch(df, f"{folder}/rows", n)).outputMode(mode)
             .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


@pytest.mark.parametrize("gap_mode", ["retained", "last"])
def test_stream_equals_batch_over_many_micro_batches(spark, folder, gap_mode):
    rng = random.Random(11)
    rows = [transaction(i, i // 4 + rng.randrange(2), f"C{rng.randrange(5)}", f"M{rng.randrange(6)}", float(rng.randrange(1, 50)),
                        rng.choice(["CASH_OUT", "TRANSFER", "DEBIT"])) for i in range(240)]
    schema = write_steps(spark, rows, f"{folder}/in", 4)
    stateful.use_rocksdb(spark)
    stream = readers.file_events(spark, f"{folder}/in", schema, maxFilesPerTrigger=1)
    got = {r["event_id"]: r for r in run_stream(spark, stateful.behavioral_stream(stream, gap_mode=gap_mode), folder).collect()}
    want = sequential_behavior(rows, gap_mode)
    assert set(got) == set(want)
    late = [i for i, r in got.items() if r["late"]]
    for event, features in want.items():
        for name, value in features.items():
            assert got[event][name] == pytest.approx(value, abs=1e-9), (event, name)
    assert not late and all(got[1][f] is not None for f in _FEATURES)


def test_late_rows_are_marked_and_see_no_future(spark, folder):
    first, second = [transaction(1, 30, target="M2"), transaction(2, 31)], [transaction(3, 10, target="M9")]
    stateful.use_rocksdb(spark)
    frame(spark, first).coalesce(1).write.parquet(f"{folder}/in")
    stream = readers.file_events(spark, f"{folder}/in", frame(spark, first).schema, maxFilesPerTrigger=1)
    run_stream(spark, stateful.behavioral_stream(stream), folder)
    frame(spark, second).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    got = {r["event_id"]: r for r in run_stream(spark, stateful.behavioral_stream(
        readers.file_events(spark, f"{folder}/in", frame(spark, first).schema, maxFilesPerTrigger=1)), folder).collect()}
    assert got[3]["late"] is True and got[3]["orig_tx_count_24steps"] == 0.0 and got[3]["orig_new_destination"] == 1.0
    assert got[2]["late"] is False and got[2]["orig_tx_count_1step"] == 1.0


def test_router_replay_changes_nothing(spark, folder):
    from tallywatch.operators.route import assign_tiers, decide

    names = "transaction_id string, step int, type string, amount double, nameOrig string, nameDest string, oldbalanceOrg double, newbalanceOrig double, oldbalanceDest double, newbalanceDest double"
    batch = spark.createDataFrame([(f"t{i}", 1, "DEBIT", float(i), "C", "M", 1.0, 0.0, 0.0, 1.0) for i in range(-1, 5)], names)

    def decisions(df):
        return decide(assign_tiers(df.withColumns({"anomaly_score": F.col("amount") / 20 - 0.1, "second_stage_probability": F.lit(0.1)})))

    run = router.route_batch(decisions, folder)
    for _ in range(2):
        run(batch, 7)
    sent = spark.read.parquet(f"{folder}/messages").collect()
    assert sorted(r["key"] for r in sent) == [f"t{i}" for i in range(5)]
    assert {r["key"]: r["route"] for r in sent}["t4"] == "fraud-alerts"
    assert spark.read.parquet(f"{folder}/counters").first()["total"] == 5
    assert spark.read.parquet(f"{folder}/rejects").first()["violations"] == ["negative:amount"]


def test_retries_then_stop():
    calls, pauses = [], []

    def fail():
        calls.append(1)
        raise RuntimeError("down")

    with pytest.raises(RuntimeError):
        router.with_retries(fail, pause=pauses.append)
    assert len(calls) == 3 and pauses == [1.0, 2.0]
    assert router.with_retries(lambda: "done") == "done"


def test_streaming_rates_close_with_the_watermark(spark, folder):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(seconds=30 * i), "a") for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string")
    df.coalesce(1).write.parquet(f"{folder}/in")
    stream = readers.file_events(spark, f"{folder}/in", df.schema)
    got = run_stream(spark, router.streaming_event_rates(stream, ["kind"], lateness="1 minute"), folder, "append").collect()
    full = [r for r in got if r["window_start"] >= start and r["n"] == 10]
    assert full and all(r["per_second"] == pytest.approx(10 / 300) for r in full)


def test_dead_letters_keep_raw_bytes(spark):
    values = [b'{"transaction_id": "t"}', b'{"alert_id": "a"}', b"{}", b"[1]", b"\xff\xfe", b"{", None]
    raw = spark.createDataFrame([(bytearray(v) if v is not None else None, "alerts", 0, i) for i, v in enumerate(values)],
                                "value binary, topic string, partition int, offset long")
    decoded = writers.decode_alerts(raw)
    assert [r["offset"] for r in decoded.where("error_code IS NULL").orderBy("offset").collect()] == [0, 1]
    letters = writers.dead_letters(decoded).orderBy("source_offset").collect()
    assert [r["source_offset"] for r in letters] == [2, 3, 4, 5, 6]
    import base64

    assert base64.b64decode(letters[2]["raw_value_base64"]) == b"\xff\xfe"


def test_messages_leave_out_nulls(spark):
    df = spark.createDataFrame([("t", 1.5, None)], "transaction_id string, amount double, risk_level string")
    row = writers.decision_messages(df).first()
    assert row["key"] == "t" and json.loads(row["value"]) == {"transaction_id": "t", "amount": 1.5}


def test_upsert_is_idempotent_and_touches_its_dates_only(spark, folder):
    schema = "k string, event_date string, v int, o int"
    writers.upsert(spark, folder + "/t", spark.createDataFrame([("a", "d1", 1, 1), ("b", "d2", 1, 1), ("a", "d1", 0, 0)], schema), ["k", "event_date"], "o")
    before = {f for f in spark.read.parquet(folder + "/t").inputFiles() if "event_date=d2" in f}
    for _ in range(2):
        writers.upsert(spark, folder + "/t", spark.createDataFrame([("a", "d1", 9, 2), ("c", "d1", 3, 2)], schema), ["k", "event_date"], "o")
    table = spark.read.parquet(folder + "/t")
    assert sorted((r["k"], r["v"]) for r in table.collect()) == [("a", 9), ("b", 1), ("c", 3)]
    assert {f for f in table.inputFiles() if "event_date=d2" in f} == before


def test_upsert_rewrites_the_buckets_of_its_keys_only(spark, folder):
    schema, keys = "k string, event_date string, v int, o int", ["k", "event_date"]
    rows = [(f"k{i}", "d1", 1, 1) for i in range(400)]
    writers.upsert(spark, folder + "/t", spark.createDataFrame(rows, schema).repartition(5), keys, "o", buckets=16)
    before = set(spark.read.parquet(folder + "/t").inputFiles())
    assert len(before) == 16  # one file a bucket
    writers.upsert(spark, folder + "/t", spark.createDataFrame([("k7", "d1", 5, 2), ("k7", "d1", 4, 1), ("k8", "d1", 9, 0)], schema), keys, "o", buckets=16)
    table = spark.read.parquet(folder + "/t")
    got = {r["k"]: r["v"] for r in table.collect()}
    assert len(got) == table.count() == 400 and got["k7"] == 5 and got["k8"] == 1
    assert 1 <= len(before - set(table.inputFiles())) <= 2 and len(table.inputFiles()) == 16
    with pytest.raises(ValueError):
        writers.upsert(spark, folder + "/t", spark.createDataFrame(rows[:1], schema), keys, "o", buckets=4)
    with pytest.raises(Exception, match="event_date is null"):
        writers.upsert(spark, folder + "/t", spark.createDataFrame([("x", None, 1, 1)], schema), keys, "o", buckets=16)
    assert spark.read.parquet(folder + "/t").count() == 400


def test_csv_ordinals_follow_the_files(spark, folder):
    df = spark.range(1000).select(F.lit(1).alias("step"), F.lit("DEBIT").alias("type"), F.col("id").cast("double").alias("amount"),
                                  *[F.lit("x").alias(c) for c in ("nameOrig",)], F.lit(0.0).alias("oldbalanceOrg"), F.lit(0.0).alias("newbalanceOrig"),
                                  F.lit("y").alias("nameDest"), F.lit(0.0).alias("oldbalanceDest"), F.lit(0.0).alias("newbalanceDest"),
                                  F.lit(0).alias("isFraud"), F.lit(0).alias("isFlaggedFraud"))
    df.repartitionByRange(5, "amount").sortWithinPartitions("amount").write.option("header", True).csv(folder + "/c")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = readers.with_file_ordinal(readers.read_csv(spark, folder + "/c")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["source_row_id"], r["amount"]) for r in rows) == [(i, float(i)) for i in range(1000)]


def test_bad_csv_lines_and_documents(spark, folder):
    import pathlib

    path = pathlib.Path(folder)
    (path / "a.csv").write_text("step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,isFraud,isFlaggedFraud\n"
                                "1,DEBIT,2.5,C,1,1,M,1,1,0,0\nx,DEBIT,oops,C,1,1,M,1,1,0,0\n")
    assert [r["amount"] for r in readers.read_csv(spark, str(path / "a.csv")).collect()] == [2.5]
    assert readers.read_csv(spark, str(path / "a.csv"), as_text=True).count() == 2
    (path / "kb" / "deep").mkdir(parents=True)
    (path / "kb" / "one.md").write_text("# One")
    (path / "kb" / "deep" / "two.md").write_bytes(b"bad \xff byte")
    (path / "kb" / "skip.txt").write_text("no")
    got = {r["relative_path"]: r["text"] for r in readers.read_documents(spark, str(path / "kb")).collect()}
    assert got == {"one.md": "# One", "deep/two.md": "bad � byte"}


def test_event_mapping(spark):
    df = spark.createDataFrame([("3", "7", "DEBIT", "1.5", "C", "", 1), ("4", "0", "DEBIT", "1", "C", "t9", 2)],
                               "step string, event_step string, type string, amount string, nameOrig string, transaction_id string, n int")
    for name in ("oldbalanceOrg", "newbalanceOrig", "nameDest", "oldbalanceDest", "newbalanceDest"):
        df = df.withColumn(name, F.lit("1"))
    rows = readers.to_events(df, batch_id="b", sequence="n").collect()
    assert [r["event_step"] for r in rows] == [7, 4] and rows[0]["transaction_id"].startswith("TXN-") and rows[1]["transaction_id"] == "t9"
    assert rows[0]["producer_sequence"] == 1 and rows[0]["event_time"] and rows[0]["isFraud"] is None


def test_offsets_make_one_order(spark):
    df = spark.createDataFrame([(1, 5), (0, 9), (1, 2)], "kafka_partition int, kafka_offset long")
    got = [tuple(r)[:2] for r in df.withColumn("o", readers.event_order()).orderBy("o").collect()]
    assert got == [(0, 9), (1, 2), (1, 5)]


def test_export_check_counts_differences(spark):
    left = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "id int, v double")
    same = writers.export_differences(left, left, "id").first()
    assert (same["unmatched_rows"], same["differing_rows"], same["same_columns"]) == (0, 0, True)
    right = spark.createDataFrame([(1, 1.000001), (2, 2.1), (4, 1.0)], "id int, v double")
    row = writers.export_differences(left, right, "id").first()
    assert (row["unmatched_rows"], row["differing_rows"]) == (2, 1)


def planted(spark, n=2000):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(n, 4))
    data[:10] += 8
    return spark.createDataFrame([(i, int(i < 10), *map(float, row)) for i, row in enumerate(data)],
                                 "id long, isFraud int, a double, b double, c double, d double").repartition(6)


def test_forest_ranks_planted_outliers_first_and_is_seeded(spark):
    df, names = planted(spark), list("abcd")
    nodes = forest.train_forest(df.where("isFraud = 0"), names, "id", 60)
    model = forest.Forest.load(nodes, names)
    scores = {r["id"]: r["anomaly_score"] for r in forest.score_forest(df, model).collect()}
    assert set(sorted(scores, key=scores.get)[-10:]) == set(range(10))
    assert all(-0.5 < s < 0.5 for s in scores.values())
    again = forest.Forest.load(forest.train_forest(df.where("isFraud = 0").repartition(3), names, "id", 60), names)
    assert np.array_equal(model.threshold, again.threshold) and np.array_equal(model.path, again.path)
    other = forest.Forest.load(forest.train_forest(df.where("isFraud = 0"), names, "id", 60, seed=1), names)
    assert not np.array_equal(model.threshold, other.threshold)
    assert len(model.roots) == 60


def test_tree_samples_are_bounded(spark):
    df = planted(spark, 5000)
    sizes = [r["count"] for r in forest.tree_samples(df, ["a"], "id", 30, 64, 1).groupBy("tree").count().collect()]
    assert len(sizes) == 30 and min(sizes) >= 64 and max(sizes) < 200
    small = forest.tree_samples(df.limit(20), ["a"], "id", 5, 64, 1)
    assert small.count() == 100
    with pytest.raises(ValueError):
        forest.train_forest(df, ["a"], "id", trees=10_000_000)
    with pytest.raises(ValueError):
        forest.train_forest(df.limit(0), ["a"], "id")


def test_forest_paths_match_a_plain_walk(spark):
    df, names = planted(spark, 300), list("abcd")
    model = forest.Forest.load(forest.train_forest(df, names, "id", 5), names)
    row = np.array([[0.1, -0.2, 0.3, 4.0]])
    lengths = []
    for root in model.roots:
        node = root
        while np.isfinite(model.threshold[node]):
            node = model.left[node] + (row[0, model.feature[node]] > model.threshold[node])
        lengths.append(model.path[node])
    want = 2 ** (-np.mean(lengths) / float(forest.average_path(256))) - 0.5
    assert model.scores(row)[0] == pytest.approx(want)


def test_second_stage_learns_and_picks_by_recall(spark):
    df = planted(spark, 1500).withColumn("isFraud", (F.col("a") > 1.0).cast("int"))
    train, valid = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    stage, table = cascade.train_second_stage(train, valid, list("abcd"), configs=[{"maxIter": 3, "maxDepth": 2}, {"maxIter": 2, "maxDepth": 1}])
    best = max((r["recall"], r["f1"], -r["fp"], -r["fn"]) for r in table)
    mine = [r for r in table if r["threshold"] == stage.threshold and (r["recall"], r["f1"], -r["fp"], -r["fn"]) == best]
    assert mine and len(table) == 28
    out = stage.apply(valid)
    assert out.where("second_stage_probability BETWEEN 0 AND 1").count() == valid.count()
    with pytest.raises(ValueError):
        cascade.train_second_stage(train.where("isFraud = 0"), valid, list("abcd"))


def test_reconstruction_error_matches_numpy(spark):
    df, names = planted(spark, 400), list("abcd")
    got = {r["id"]: r["reconstruction_error"] for r in cascade.reconstruction_error(df, df, names, 2).collect()}
    rows = df.orderBy("id").toPandas()
    z = (rows[names] - rows[names].mean()) / rows[names].std(ddof=0)
    _, vectors = np.linalg.eigh(np.cov(z.to_numpy().T))
    axes = vectors[:, -2:]
    error = ((z.to_numpy() - z.to_numpy() @ axes @ axes.T) ** 2).mean(axis=1)
    assert np.allclose([got[i] for i in rows["id"]], error)


def test_top_features_and_verdicts(spark):
    df = spark.createDataFrame([(1.0, 5.0, 3.0, 0.2), (0.0, 5.0, 1.0, -0.2)], "a double, b double, c double, anomaly_score double")
    scaler = cascade.Scaler.fit(df, list("abc"))
    out = cascade.record_verdicts(scaler.transform(df), list("abc"), {"T1": -0.1, "T2": 0.0, "T3": 0.05, "T4": 0.1}, 0.0).collect()
    assert out[0]["top_contributing_features"] == ["a (z=1.00)", "c (z=1.00)", "b (z=0.00)"]
    assert (out[0]["recommended_action"], out[0]["is_anomaly"]) == ("Immediate Escalation / Audit", True)
    assert (out[1]["recommended_action"], out[1]["risk_level"]) == ("Automated Pass", "L1")


def test_csv_lines_number_every_row_once(spark, folder):
    import pathlib

    path = pathlib.Path(folder) / "uneven"
    path.mkdir()
    head = "step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,isFraud,isFlaggedFraud\n"
    good = '{},"DE,BIT",2.5,C,1,1,M,1,1,0,0\n'
    for name in "ab":
        lines = [good.format(i) for i in range(1, 11)]
        lines[3] = "4,DEBIT,2.5,C,1,1,M,1,1,0,0,9,9\n"
        lines[6] = "7,DEBIT,oops,C\n"
        lines[8] = "  \n"
        (path / f"{name}.csv").write_text(head + "".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    try:
        lines = readers.csv_lines(spark, str(path))
        rows = readers.csv_rows(lines)
        got = sorted((r["source_row_id"], r["step"], r["type"], r["amount"], r["isFraud"]) for r in rows.collect())
        assert rows.count() == len(got) == 16
        rejects = sorted((r["file"][-5:], r["line_number"], r["reject"]) for r in lines.where("reject IS NOT NULL").collect())
        assert readers.first_rows(rows, 12).count() == len(readers.first_rows(rows, 12).collect()) == 12
        assert readers.csv_rows(readers.csv_lines(spark, str(path)), as_text=True).where("amount = 'oops'").count() == 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    steps = [1, 2, 3, 5, 6, 7, 8, 10] * 2
    want = [(i, s, *(("DEBIT", None, None) if s == 7 else ("DE,BIT", 2.5, 0))) for i, s in enumerate(steps)]
    assert got == want
    assert rejects == [(f, n, why) for f in ("a.csv", "b.csv") for n, why in ((5, "too many fields"), (10, "blank"))]


def test_second_stage_computes_its_rows_once(spark):
    """Counts, training and the sweep read the same rows: each input row is computed one time."""
    from tallywatch.operators import cascade

    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def label(i):
        seen.add(1)
        return int(i % 4 == 0)

    rows = spark.range(0, 200, 1, 2).select((F.col("id") % 4).cast("double").alias("a"), F.rand(1).alias("b"), label.asNondeterministic()("id").alias("isFraud"))
    stage, table = cascade.train_second_stage(rows, rows.select("*"), ["a", "b"], configs=[{"maxDepth": 2, "maxIter": 2}] * 2)
    assert stage is not None and table and seen.value <= 400
