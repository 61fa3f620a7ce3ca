"""Micro-batch routing: one scored frame, two outputs, rejects and counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallywatch.operators.route import decision_counts, routed
from tallywatch.operators.validate import split_rejects, transaction_rules
from tallywatch.sources.writers import dead_letters, decode_alerts, decision_messages

TRIGGER = "5 seconds"
ATTEMPTS = 3


def write_batch(df: DataFrame, path: str, batch_id: int, *partitions: str) -> None:
    """Replace the output of one micro-batch, so a replay changes nothing."""
    tagged = df.withColumn("micro_batch", F.lit(int(batch_id)).cast("long"))
    (tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("micro_batch", *partitions).parquet(path))


def route_batch(decide: Callable[[DataFrame], DataFrame], folder: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: validate, decide, write both routes in one pass.

    The decided frame is kept for the messages and the counters of the batch and
    released afterwards.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_rejects(batch, transaction_rules())
        write_batch(bad, f"{folder}/rejects", batch_id)
        decided = routed(decide(good)).persist()
        try:
            write_batch(decision_messages(decided, "route"), f"{folder}/messages", batch_id, "route")
            write_batch(decision_counts(decided), f"{folder}/counters", batch_id)
        finally:
            decided.unpersist()

    return run


def start_router(stream: DataFrame, decide: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str,
                 available_now: bool = False) -> StreamingQuery:
    writer = (stream.writeStream.foreachBatch(route_batch(decide, folder)).outputMode("update")
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TRIGGER)).start()


def with_retries(action: Callable[[], None], attempts: int = ATTEMPTS, pause: Callable[[float], None] | None = None) -> None:
    """Run a batch action a few times with growing pauses, then let it fail the query."""
    import time

    for attempt in range(1, attempts + 1):
        try:
            return action()
        except Exception:
            if attempt == attempts:
                raise
            (pause or time.sleep)(min(2.0 ** (attempt - 1), 4.0))


def alert_intake(handle: Callable[[DataFrame, int], None], folder: str,
                 pause: Callable[[float], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for raw alert messages.

    Malformed records go to the dead-letter table of the same micro-batch; the
    rest go to ``handle``. Both are retried; a batch that still fails stops the
    query with its offsets uncommitted.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        decoded = decode_alerts(batch)
        with_retries(lambda: write_batch(dead_letters(decoded), f"{folder}/dead_letters", batch_id), pause=pause)
        good = decoded.where(F.col("error_code").isNull()).drop("error_code")
        with_retries(lambda: handle(good, batch_id), pause=pause)

    return run


def deduplicated_stream(df: DataFrame, key: str, ts: str, lateness: str = "1 hour") -> DataFrame:
    """Drop repeated ids that arrive within the allowed lateness."""
    return df.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def streaming_event_rates(df: DataFrame, series: list[str], ts: str = "ts", length: int = 5, lateness: str = "10 minutes") -> DataFrame:
    """Sliding event rates on a stream; windows close once the watermark passes."""
    spans = F.window(ts, f"{length} minutes", "1 minute")
    counted = df.withWatermark(ts, lateness).groupBy(*series, spans.alias("w")).agg(F.count("*").alias("n"))
    return counted.select(*series, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n",
                          (F.col("n") / F.lit(length * 60)).alias("per_second"))
