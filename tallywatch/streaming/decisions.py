"""The streaming decision job from raw records to both routes, one ledger row for each micro-batch.

One query does it all: rules mark bad records, the state operator adds behaviour features to the others, and each
micro-batch is scored, decided and written. The batch is kept once, so the state operator runs once for all outputs.
Every output is a table partitioned by micro-batch that a replay replaces. The ledger row comes last: a batch counts as done only with it, and
``committed`` shows rows of such batches only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallywatch.operators.cascade import SecondStage
from tallywatch.operators.features import base_features
from tallywatch.operators.forest import Forest, score_forest
from tallywatch.operators.route import assign_tiers, decide, routed
from tallywatch.operators.validate import transaction_rules, violations
from tallywatch.sources.writers import decision_messages
from tallywatch.streaming.router import TRIGGER, write_batch
from tallywatch.streaming.stateful import behavioral_stream

OUTPUTS = ("decisions", "messages", "rejects")


def feature_stream(events: DataFrame, order: str = "event_id", gap_mode: str = "retained", history: DataFrame | None = None) -> DataFrame:
    """All records of a stream: good ones with base and behaviour features, bad ones with the ``violations`` of their rules.

    ``violations`` is null in good rows, the features are null in bad ones. ``history`` hands over the state of earlier rows.
    """
    marked = events.withColumn("violations", violations(transaction_rules()))
    good = marked.where(F.size("violations") == 0).drop("violations")
    bad = marked.where(F.size("violations") > 0)
    return base_features(behavioral_stream(good, order, gap_mode, history=history)).unionByName(bad, allowMissingColumns=True)


def model_decider(forest: Forest, stage: SecondStage) -> Callable[[DataFrame], DataFrame]:
    """Decisions by a trained forest, which is shipped to the executors, and a trained second stage."""

    def run(rows: DataFrame) -> DataFrame:
        return decide(stage.apply(assign_tiers(score_forest(rows, forest))), threshold=stage.threshold)

    return run


def _counters() -> list:
    direct, hit = F.col("risk_level").isin("L3", "L4", "L5"), F.coalesce(F.col("xgboost_prediction") == 1, F.lit(False))
    return [F.count(F.lit(1)).alias("total"), F.count_if(~direct).alias("second_stage_input"), F.count_if(direct).alias("direct_alerts"),
            F.count_if(~direct & hit).alias("second_stage_alerts"), F.count_if(~direct & ~hit).alias("low_risk")]


def _observed(seen: Observation, names: list[str], rows: int) -> list[int]:
    """The counters of a write that is done; without rows the optimizer may leave the counting out."""
    return [int(seen.get[n]) for n in names] if rows else [0] * len(names)


def decision_batch(decide_rows: Callable[[DataFrame], DataFrame], folder: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over rows of ``feature_stream``: rejects, decisions by route, messages, then the ledger row.

    The counters come from the write of the decisions itself, not from another pass.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        try:
            bad, good = rows.where("violations IS NOT NULL"), rows.where("violations IS NULL").drop("violations")
            n = rows.agg(F.count("*"), F.count("violations")).first()
            write_batch(bad, f"{folder}/rejects", batch_id)
            seen = Observation()
            counters = _counters()
            decided = routed(decide_rows(good)).observe(seen, *counters)
            write_batch(decided, f"{folder}/decisions", batch_id, "route")
            names = ["total", "second_stage_input", "direct_alerts", "second_stage_alerts", "low_risk"]
            values = _observed(seen, names, n[0] - n[1])
            stored = spark.read.schema(decided.schema).parquet(f"{folder}/decisions/micro_batch={int(batch_id)}") if values[0] else decided.limit(0)
            write_batch(decision_messages(stored, "route"), f"{folder}/messages", batch_id, "route")
            ledger = spark.createDataFrame([(int(n[0]), int(n[1]), *values)], "records long, rejects long, " + ", ".join(f"{c} long" for c in names))
            write_batch(ledger, f"{folder}/ledger", batch_id)
        finally:
            rows.unpersist()

    return run


def start_decisions(features: DataFrame, decide_rows: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Start the job on rows of ``feature_stream``; the checkpoint holds offsets and state."""
    writer = features.writeStream.foreachBatch(decision_batch(decide_rows, folder)).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TRIGGER)).start()


def committed(spark: SparkSession, folder: str, output: str) -> DataFrame:
    """Rows of an output whose micro-batch has its ledger row; a batch that failed half-way shows nothing."""
    done = spark.read.parquet(f"{folder}/ledger").select("micro_batch").distinct()
    return spark.read.option("mergeSchema", "true").parquet(f"{folder}/{output}").join(F.broadcast(done), "micro_batch", "left_semi")
