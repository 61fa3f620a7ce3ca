from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywatch.operators import evaluate, profile, splits


def scored(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, round(rng.random() * 2, 1), int(rng.random() < 0.2), rng.randrange(50)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, score double, label int, step int")


def test_sweep_folds_the_open_top_interval(spark):
    rows, df = scored(spark)
    grid = [0.5, 0.1, 1.0, 0.5]
    out = evaluate.threshold_sweep(df, "score", "label", grid).orderBy("ordinal").collect()
    assert [r["threshold"] for r in out] == grid
    for r in out:
        said = [(s >= r["threshold"], y) for _, s, y, _ in rows]
        assert r["tp"] == sum(a and y == 1 for a, y in said) and r["fp"] == sum(a and y == 0 for a, y in said)
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == len(rows)
    beyond = evaluate.threshold_sweep(df, "score", "label", [99.0]).first()
    assert (beyond["tp"], beyond["alerts"], beyond["precision"]) == (0, 0, 0.0)
    with pytest.raises(ValueError):
        evaluate.threshold_sweep(df, "score", "label", [])


def test_ranking_metrics_match_the_pairwise_definition(spark):
    rows, df = scored(spark)
    got = evaluate.ranking_metrics(df, "score", "label").first()
    pos, neg = [s for _, s, y, _ in rows if y], [s for _, s, y, _ in rows if not y]
    pairs = np.array([[1.0 if p > n else 0.5 if p == n else 0.0 for n in neg] for p in pos])
    assert got["roc_auc"] == pytest.approx(pairs.mean())
    reverse = evaluate.ranking_metrics(df.withColumn("score", -F.col("score")), "score", "label").first()
    assert reverse["roc_auc"] == pytest.approx(1 - got["roc_auc"])
    one = evaluate.ranking_metrics(df.where("label = 0"), "score", "label").first()
    assert one["roc_auc"] is None and one["pr_auc"] is None


def test_thresholds_and_guards(spark):
    rows, df = scored(spark, 3000)
    spread = df.withColumn("score", F.col("score") + F.col("id") / 1e5)
    found = evaluate.tier_thresholds(spread, "score", "label")
    legit = [s + i / 1e5 for i, s, y, _ in rows if y == 0]
    assert found["T1"] == pytest.approx(float(np.quantile(legit, 0.99)))
    with pytest.raises(ValueError):
        evaluate.tier_thresholds(df.withColumn("score", F.lit(1.0)), "score", "label")
    report = spark.createDataFrame([("validation", 10, 2, 1, 0)],
                                   "split string, total_rows int, fraud_rows int, fraud_in_L1 int, fraud_in_L2 int")
    assert evaluate.require_fraud(report) is report
    for bad in ({"fraud_rows": 0}, {"fraud_in_L1": 0}):
        with pytest.raises(ValueError):
            evaluate.require_fraud(report.withColumns({k: F.lit(v) for k, v in bad.items()}))


def test_picks_and_targets(spark):
    rows = [(0, 0.1, 0.2, 0.9, 0.3, 9, 40, 1), (1, 0.2, 0.5, 0.9, 0.6, 9, 9, 1), (2, 0.3, 0.9, 0.5, 0.6, 5, 1, 5)]
    sweep = spark.createDataFrame(rows, "ordinal int, threshold double, precision double, recall double, f1 double, tp int, fp int, fn int"
                                  ).withColumns({"tn": F.lit(0), "alerts": F.lit(0), "alert_rate": F.lit(0.0)})
    assert evaluate.best_f1(sweep).first()["ordinal"] == 1
    assert evaluate.best_by_recall(sweep).first()["ordinal"] == 1
    per = {r["target_recall"]: r for r in evaluate.best_per_recall_target(sweep, [0.4, 0.8, 0.95]).collect()}
    assert per[0.4]["threshold"] == 0.3 and per[0.8]["threshold"] == 0.2
    assert per[0.95]["achieved"] is False and per[0.95]["threshold"] is None
    cost = evaluate.incremental_cost(evaluate.best_per_recall_target(sweep, [0.4, 0.8])).orderBy("target_recall").collect()
    assert cost[0]["fp_per_additional_tp"] is None and cost[1]["fp_per_additional_tp"] == pytest.approx(8 / 4)


@pytest.mark.parametrize("n", [0, 1, 7, 503])
def test_chronological_split_has_exact_sizes_and_order(spark, n):
    rows, df = scored(spark, max(n, 1))
    df = df.limit(0) if n == 0 else df
    out = splits.chronological_split(df, ["step", "score", "id"]).collect()
    order = sorted(out, key=lambda r: (r["step"], r["score"], r["id"]))
    sizes = splits.expected_sizes(n, (0.6, 0.2, 0.2))
    assert [r["split"] for r in order] == ["train"] * sizes[0] + ["validation"] * sizes[1] + ["test"] * sizes[2]


def test_chronological_split_with_one_hot_step(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 40).cast("int").alias("step"),
                                  F.lit(1.0).alias("score"))
    out = sorted(splits.chronological_split(df, ["step", "score", "id"]).collect(), key=lambda r: (r["step"], r["id"]))
    assert [r["split"] for r in out] == ["train"] * 1800 + ["validation"] * 600 + ["test"] * 600


def test_stratified_split_and_sample_are_seeded(spark):
    _, df = scored(spark, 1000)
    first = splits.stratified_split(df, "label", "id")
    counts = {(r["label"], r["split"]): r["count"] for r in first.groupBy("label", "split").count().collect()}
    for label in (0, 1):
        total = sum(v for (y, _), v in counts.items() if y == label)
        assert counts[(label, "train")] == int(0.6 * total)
    again = splits.stratified_split(df.repartition(7), "label", "id")
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    # Which rows are drawn is fixed, their order is not.
    ids = {r["id"] for r in splits.seeded_sample(df, "id", 50).collect()}
    assert len(ids) == 50 and ids == {r["id"] for r in splits.seeded_sample(df.repartition(5), "id", 50).collect()}
    assert ids != {r["id"] for r in splits.seeded_sample(df, "id", 50, seed=1).collect()}


def test_profile_of_small_table(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, "b", 4.0)], "i int, s string, d double")
    audit = {r["column_name"]: r for r in profile.column_audit(df).collect()}
    assert (audit["d"]["missing"], audit["d"]["distinct_values"], audit["s"]["distinct_values"]) == (2, 1, 2)
    assert audit["s"]["mean"] is None and audit["i"]["mean"] == pytest.approx(4 / 3)
    assert {r["column_name"] for r in profile.column_audit(df, approximate=True).collect()} == {"i", "s", "d"}
    assert profile.duplicate_rows(df).first()["duplicate_rows"] == 1
    stats = {r["feature"]: r for r in profile.describe_columns(df, ["i", "d"]).collect()}
    assert stats["i"]["median"] == 1.0 and stats["d"]["missing"] == 2


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4, 4)], "v double")
    assert {r["bin"]: r["n"] for r in evaluate.histogram(df, "v", 4).collect()} == {0: 1, 1: 1, 2: 1, 3: 3}
    assert evaluate.histogram(df.withColumn("v", F.lit(1.0)), "v", 4).first()["n"] == 6
    assert evaluate.histogram(df.limit(0), "v", 4).count() == 0
