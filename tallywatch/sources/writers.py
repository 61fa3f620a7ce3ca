"""Sinks: messages, keyed tables, exports, dead letters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallywatch.schema import DECISION_PAYLOAD

# Columns of the ledger export.
LEDGER_COLUMNS = ["transaction_id", "batch_id", "type", "amount", "nameOrig", "nameDest", "step", "risk_level", "anomaly_score",
                  "xgboost_probability", "final_prediction", "final_decision", "isFraud", "kafka_status",
                  "investigation_status"]

# Buckets of a keyed table inside each partition, and the start of the column that names them.
BUCKETS = 8
BUCKET_COLUMN = "key_bucket_of_"


def decision_messages(df: DataFrame, *keep: str) -> DataFrame:
    """Key and JSON value per decision; null fields are left out of the JSON."""
    fields = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in DECISION_PAYLOAD]
    return df.select(F.col("transaction_id").cast("string").alias("key"), F.to_json(F.struct(*fields)).alias("value"), *keep)


def publish(messages: DataFrame, topic: str, servers: str | None = None, folder: str | None = None) -> None:
    """Send messages to a topic, or append them to a folder that plays its part."""
    if servers:
        (messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save())
    elif folder:
        messages.write.mode("append").parquet(f"{folder}/{topic}")
    else:
        raise ValueError("name the servers of the topic or a folder")


def last_write(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The newest row per key; reduced before the shuffle, so hot keys are cheap."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return newest.select(*keys, "_row.*").select(*df.columns)


def upsert(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], order: str,
           partition: str = "event_date", buckets: int = BUCKETS) -> None:
    """Keyed upsert into a parquet table partitioned by a column that the key fixes, and in it by buckets of the key.

    Only the buckets that the batch touches are read and rewritten, each replaced as a whole on commit and written by one
    task, so a hot partition is spread over ``buckets`` tasks and files. Repeating a batch gives the same table. The
    number of buckets belongs to the table: another one is refused, and so are rows without a partition value.
    """
    bucket = f"{BUCKET_COLUMN}{buckets}"
    given = F.when(F.col(partition).isNull(), F.raise_error(F.lit(f"{partition} is null"))).otherwise(F.col(partition))
    newest = last_write(incoming, keys, order).withColumns({
        partition: given, bucket: F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")})
    try:
        names = spark.read.parquet(path).columns
    except AnalysisException as error:
        # A new table; an empty folder has no schema.
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        names = []
    merged = newest
    if names:
        if bucket not in names:
            raise ValueError(f"{path} is not a table of {buckets} buckets: {names}")
        # At most one row per partition and bucket of the batch; the scan is pruned by it at run time.
        touched = F.broadcast(newest.select(partition, bucket).distinct())
        stored = spark.read.schema(newest.schema).parquet(path).join(touched, [partition, bucket], "left_semi")
        merged = stored.select(*newest.columns).unionByName(newest)
    # Rows of a bucket meet once: the aggregation and the write share this shuffle.
    placed = merged.repartition(partition, bucket)
    rest = [c for c in newest.columns if c not in (*keys, partition, bucket)]
    by = list(dict.fromkeys([partition, bucket, *keys]))
    final = placed.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(*by, "_row.*").select(*newest.columns)
    final.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition, bucket).parquet(path)


def document_lines(df: DataFrame) -> DataFrame:
    return df.select(F.col("document_id").alias("id"), "text", "metadata")


def export_documents(df: DataFrame, path: str) -> None:
    """JSON lines with id, text and metadata."""
    document_lines(df).write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).csv(path)


def score_export(df: DataFrame, unique: str, label: str, score: str, prediction: str) -> DataFrame:
    return df.select(unique, F.col(label).alias("label"), F.col(score).alias("anomaly_score"),
                     F.col(prediction).alias("prediction"))


def ledger_export(df: DataFrame) -> DataFrame:
    """The fifteen ledger columns as text; absent values become empty."""
    return df.select(*[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c)
        for c in LEDGER_COLUMNS])


def export_differences(expected: DataFrame, actual: DataFrame, key: str, rtol: float = 1e-5, atol: float = 1e-6) -> DataFrame:
    """One row: sizes, column agreement and rows whose numbers differ beyond the tolerance."""
    names = [c for c in expected.columns if c != key]
    same_columns = sorted(expected.columns) == sorted(actual.columns)
    shared = [c for c in names if c in actual.columns]
    left = expected.select(F.col(key), F.lit(1).alias("_l"), *[F.col(c).cast("double").alias(f"l_{c}") for c in shared])
    right = actual.select(F.col(key), F.lit(1).alias("_r"), *[F.col(c).cast("double").alias(f"r_{c}") for c in shared])
    differs = F.lit(False)
    for name in shared:
        a, b = F.col(f"l_{name}"), F.col(f"r_{name}")
        close = F.abs(a - b) <= atol + rtol * F.abs(b)
        differs = differs | ~F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(close)
    return left.join(right, key, "full_outer").agg(
        F.count("_l").alias("expected_rows"), F.count("_r").alias("actual_rows"),
        F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("unmatched_rows"),
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull() & differs).alias("differing_rows"),
    ).withColumn("same_columns", F.lit(same_columns))


def decode_alerts(raw: DataFrame) -> DataFrame:
    """Marks raw alert messages that are not JSON objects or carry no id."""
    text = F.col("value").cast("string")
    utf8 = F.is_valid_utf8(text)
    body = F.try_parse_json(F.when(utf8, text))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(body), F.lit("OBJECT")), F.lit(False))
    has_id = F.lit(False)
    for name in ("transaction_id", "alert_id"):
        has_id = has_id | (F.coalesce(F.try_variant_get(body, f"$.{name}", "string"), F.lit("")) != "")
    return raw.withColumn("error_code", F.when(~(is_object & has_id), "malformed_alert"))


def dead_letters(decoded: DataFrame) -> DataFrame:
    """Reject records with their source position and the raw bytes."""
    return decoded.where(F.col("error_code").isNotNull()).select(
        F.col("topic").alias("source_topic"), F.col("partition").alias("source_partition"),
        F.col("offset").alias("source_offset"), "error_code", F.current_timestamp().alias("received_at"),
        F.base64(F.col("value").cast("binary")).alias("raw_value_base64"))


def artifact_name(alert_id: Column) -> Column:
    """A file-safe name from an alert id, at most 120 characters."""
    safe = F.regexp_replace(alert_id.cast("string"), r"[^A-Za-z0-9_.-]+", "_")
    trimmed = F.regexp_replace(safe, r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(F.substring(trimmed, 1, 120), F.lit("")), F.lit("alert"))


#: Files that one task holds open while contexts are saved; with more dates in a task, the rest are sorted.
OPEN_DATES = 64
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def save_contexts(contexts: DataFrame, path: str, date: str = "event_date") -> None:
    """Context documents as JSON, one folder per date.

    The files are gzipped, as contexts repeat much. A task writes up to ``OPEN_DATES`` dates side by side, so the wide rows are not sorted by date.
    """
    named = contexts.withColumn("artifact", artifact_name(F.col("alert_id")))
    conf = contexts.sparkSession.conf
    before = conf.get(_WRITERS)
    conf.set(_WRITERS, max(int(before), OPEN_DATES))
    try:
        named.write.mode("overwrite").option("compression", "gzip").partitionBy(date).json(path)
    finally:
        conf.set(_WRITERS, before)
