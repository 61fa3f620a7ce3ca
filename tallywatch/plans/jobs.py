"""Queries: sources, sinks, streams and models. These write under the session's scratch root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallywatch.operators import cascade, evaluate, forest, monitor, splits
from tallywatch.operators.features import base_features
from tallywatch.operators.route import DEFAULT_THRESHOLDS, assign_tiers, decide
from tallywatch.operators.validate import validate_transactions
from tallywatch.plans import inputs
from tallywatch.plans.casework import contexts, corpus_rows
from tallywatch.plans.inputs import CTE_BASE, CTE_BEHAVIOR, CTE_DECIDED, CTE_TX
from tallywatch.plans.operations import CTE_LEDGER, ledger
from tallywatch.plans.pipeline import _rounded, _rounded_sql
from tallywatch.plans.registry import query, table
from tallywatch.schema import BASE_FEATURES, BEHAVIOR_FEATURES, CSV_COLUMNS, MODEL_FEATURES
from tallywatch.session import scratch_dir
from tallywatch.sources import readers, writers
from tallywatch.streaming import alerts, decisions, router, stateful


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as wire records; every 50th value is cut off and so malformed."""
    tx = inputs.transactions(spark, sf_dir).withColumn("event_time", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    fields = ["transaction_id", "event_time", "step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig",
              "nameDest", "oldbalanceDest", "newbalanceDest", "isFraud"]
    text = F.to_json(F.struct(*fields))
    cut = F.when(F.col("event_id") % 50 == 7, F.substring(text, 1, 40)).otherwise(text)
    return tx.select(F.col("transaction_id").cast("binary").alias("key"), cut.cast("binary").alias("value"),
                     F.lit("transactions").alias("topic"), (F.col("event_id") % 6).cast("int").alias("partition"),
                     F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"))


@query("parsed_events", f"""WITH {CTE_TX}
SELECT transaction_id, step, type, amount, nameOrig, nameDest, (event_id % 6)::INT AS kafka_partition, event_id AS kafka_offset
FROM valid WHERE event_id % 50 <> 7""")
def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate_transactions(readers.parse_events(raw_events(spark, sf_dir)))
    return out.select("transaction_id", "step", "type", "amount", "nameOrig", "nameDest", "kafka_partition", "kafka_offset")


@query("malformed_event_count", f"""WITH {CTE_TX}
SELECT count(*) AS rows, count(*) FILTER (event_id % 50 = 7) AS malformed FROM tx""")
def malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readers.parse_events(raw_events(spark, sf_dir))
    return out.agg(F.count("*").alias("rows"), F.count_if(F.col("transaction_id").isNull()).alias("malformed"))


@query("decision_messages", f"""WITH {CTE_DECIDED}
SELECT transaction_id AS key, amount, risk_level, final_decision_path, xgboost_probability,
  xgboost_probability IS NOT NULL AS has_probability FROM decided""")
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = writers.decision_messages(inputs.decided(spark, sf_dir))
    value = F.col("value")
    return out.select(
        "key", F.get_json_object(value, "$.amount").cast("double").alias("amount"),
        F.get_json_object(value, "$.risk_level").alias("risk_level"),
        F.get_json_object(value, "$.final_decision_path").alias("final_decision_path"),
        F.get_json_object(value, "$.xgboost_probability").cast("double").alias("xgboost_probability"),
        F.contains(value, F.lit('"xgboost_probability"')).alias("has_probability"))


def _csv_folder(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_dir(spark, "csv")
    rows = corpus_rows(spark, sf_dir).withColumn("isFlaggedFraud", F.lit("0"))
    rows.orderBy("source_row_id").select(*CSV_COLUMNS).write.option("header", True).csv(path)
    return path


@query("csv_scan", f"""WITH {CTE_TX} SELECT step, type, amount, nameOrig, oldbalanceOrg, newbalanceOrig, nameDest,
  oldbalanceDest, newbalanceDest, isFraud, 0 AS isFlaggedFraud FROM tx""")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_csv(spark, _csv_folder(spark, sf_dir))


@query("csv_first_rows", f"""WITH {CTE_TX}
SELECT row_number() OVER (ORDER BY event_id) - 1 AS source_row_id, nameOrig, amount::VARCHAR AS amount FROM tx
QUALIFY source_row_id < 3000""")
def csv_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = readers.read_csv(spark, _csv_folder(spark, sf_dir), as_text=True)
    numbered = readers.with_file_ordinal(scan)
    return readers.first_rows(numbered, 3000).select("source_row_id", "nameOrig", "amount")


def _uneven_csv(spark: SparkSession, sf_dir: str) -> str:
    """Transactions as text lines in order: every 40th line has two fields too many, every 40th lacks its last two."""
    path = scratch_dir(spark, "uneven-csv")
    rows = corpus_rows(spark, sf_dir).withColumns({"isFlaggedFraud": F.lit("0"), "source_row_id": F.col("source_row_id").cast("long")})
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in CSV_COLUMNS])
    kind = F.pmod(F.col("source_row_id"), F.lit(40))
    line = F.when(kind == 3, F.concat(line, F.lit(",more,fields"))).when(kind == 5, F.substring_index(line, ",", 9)).otherwise(line)
    rows.orderBy("source_row_id").select(line.alias("value")).write.option("header", True).csv(path, quote="", escapeQuotes=False, sep="\u0001")
    return path


_CTE_LINES = f"""{CTE_TX}, kept AS (
SELECT *, event_id % 40 AS kind, row_number() OVER (ORDER BY event_id) - 1 AS source_row_id FROM tx WHERE event_id % 40 <> 3)"""


@query("csv_uneven_rows", f"""WITH {_CTE_LINES}
SELECT source_row_id, nameOrig, amount::VARCHAR AS amount, CASE WHEN kind <> 5 THEN isFraud::VARCHAR END AS isFraud FROM kept""")
def csv_uneven_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = readers.csv_lines(spark, _uneven_csv(spark, sf_dir))
    return readers.csv_rows(lines, as_text=True).select("source_row_id", "nameOrig", "amount", "isFraud")


@query("csv_line_rejects", f"""WITH {_CTE_LINES}
SELECT 'too many fields' AS reject, count(*) AS lines FROM tx WHERE event_id % 40 = 3 GROUP BY 1""")
def csv_line_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = readers.csv_lines(spark, _uneven_csv(spark, sf_dir))
    return lines.where("reject IS NOT NULL").groupBy("reject").agg(F.count("*").alias("lines"))


@query("producer_events", f"""WITH {CTE_TX}
SELECT transaction_id, 'paysim' AS source, 'B1' AS batch_id, event_id::INT AS producer_sequence, step, step AS event_step, type,
  amount, nameOrig, isFraud FROM tx""")
def producer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readers.to_events(inputs.transactions(spark, sf_dir), batch_id="B1", sequence="event_id")
    return out.select("transaction_id", "source", "batch_id", "producer_sequence", "step", "event_step", "type", "amount",
                      "nameOrig", "isFraud")


@query("keyed_upsert", f"""WITH {CTE_LEDGER}
SELECT nameOrig, transaction_id, strftime(generated_at, '%Y-%m-%d') AS event_date,
  CASE WHEN amount >= 20 THEN 'second' ELSE 'first' END AS version, CASE WHEN amount >= 20 THEN amount + 1 ELSE amount END AS amount
FROM ledger""")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "upsert")
    rows = ledger(spark, sf_dir).select(
        "nameOrig", "transaction_id", F.date_format("generated_at", "yyyy-MM-dd").alias("event_date"), "amount")
    first = rows.withColumns({"version": F.lit("first"), "written": F.lit(1)})
    again = rows.where("amount >= 20").withColumns({
        "amount": F.col("amount") + 1, "version": F.lit("second"), "written": F.lit(2)})
    keys = ["nameOrig", "transaction_id", "event_date"]
    for batch in (first, again, again):  # the repeated batch must change nothing
        writers.upsert(spark, path, batch, keys, "written", buckets=2)
    return spark.read.parquet(path).select("nameOrig", "transaction_id", F.col("event_date").cast("string").alias("event_date"),
                                           "version", "amount")


@query("document_folder_scan", """SELECT count(*) AS documents, sum(length(text) + 1)::BIGINT AS chars FROM documents""")
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "documents")
    docs = table(spark, sf_dir, "documents")
    docs.select("lang", "text").write.option("maxRecordsPerFile", 200).partitionBy("lang").text(path)
    files = readers.read_documents(spark, path, "*.txt")
    marks = docs.agg(F.count("*").alias("documents"))
    read = files.agg(F.sum(F.char_length("text")).alias("chars"))
    both = marks.unionByName(read, allowMissingColumns=True)
    return both.agg(F.sum("documents").alias("documents"), F.sum("chars").alias("chars"))


@query("document_lines", """SELECT doc_id::VARCHAR AS id, md5(text) AS text_md5, lang FROM documents""")
def jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "jsonl")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), "text", F.struct("lang", "source").alias("metadata"))
    writers.export_documents(docs, path)
    back = spark.read.schema("id string, text string, metadata struct<lang:string,source:string>").json(path)
    return back.select("id", F.md5("text").alias("text_md5"), "metadata.lang")


@query("feature_export_check", f"""WITH {CTE_TX}
SELECT count(*) AS expected_rows, count(*) AS actual_rows, 0::BIGINT AS unmatched_rows, 0::BIGINT AS differing_rows,
  true AS same_columns FROM valid""")
def feature_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "features")
    out = base_features(inputs.valid_transactions(spark, sf_dir)).select("event_id", *BASE_FEATURES, "isFraud")
    writers.export_csv(out, path)
    back = spark.read.schema(out.schema).option("header", True).csv(path)
    return writers.export_differences(out, back, "event_id")


@query("score_export", f"""WITH {CTE_DECIDED}
SELECT event_id, isFraud AS label, anomaly_score, alert_required AS prediction FROM decided""")
def score_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "scores")
    df = assign_tiers(inputs.scored(spark, sf_dir))
    out = writers.score_export(df, "event_id", "isFraud", "anomaly_score", "alert_required")
    writers.export_csv(out, path)
    return spark.read.schema(out.schema).option("header", True).csv(path)


@query("ledger_export", f"""WITH {CTE_LEDGER}
SELECT transaction_id, batch_id, type, amount, nameOrig, nameDest, risk_level, coalesce(final_decision, '') AS final_decision,
  kafka_status, investigation_status FROM ledger""")
def ledger_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "ledger")
    writers.export_csv(writers.ledger_export(ledger(spark, sf_dir)), path, quote_all=True)
    schema = ", ".join(f"{c} string" for c in writers.LEDGER_COLUMNS)
    back = spark.read.schema(schema).option("header", True).csv(path)
    return back.select("transaction_id", "batch_id", "type", F.col("amount").cast("double"), "nameOrig", "nameDest",
                       "risk_level", F.coalesce("final_decision", F.lit("")).alias("final_decision"), "kafka_status",
                       "investigation_status")


@query("dead_letters", f"""WITH {CTE_TX}
SELECT 'transactions' AS source_topic, (event_id % 6)::INT AS source_partition, event_id AS source_offset,
  'malformed_alert' AS error_code FROM tx WHERE event_id % 50 = 7""")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = writers.dead_letters(writers.decode_alerts(raw_events(spark, sf_dir)))
    return rejected.where(F.length("raw_value_base64") > 0).select(
        "source_topic", "source_partition", "source_offset", "error_code")


@query("saved_contexts", f"""WITH {CTE_LEDGER}
SELECT alert_id, alert_id AS artifact, strftime(generated_at, '%Y-%m-%d') AS event_date FROM ledger WHERE alert_id IS NOT NULL""")
def saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "contexts")
    dates = ledger(spark, sf_dir).where("alert_id IS NOT NULL").select(
        "alert_id", F.date_format("generated_at", "yyyy-MM-dd").alias("event_date"))
    writers.save_contexts(contexts(spark, sf_dir, dates), path)
    back = spark.read.schema("alert_id string, artifact string, event_date string").json(path)
    return back.select("alert_id", "artifact", "event_date")


@query("artifact_names", r"""WITH u AS (SELECT page_id, url FROM pages), s AS (
SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g') AS t FROM u)
SELECT page_id, coalesce(nullif(substr(regexp_replace(t, '^[._]+|[._]+$', '', 'g'), 1, 120), ''), 'alert') AS artifact FROM s""")
def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", writers.artifact_name(F.col("url")).alias("artifact"))


# ---------------------------------------------------------------- streams

def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return readers.file_events(spark, sf_dir, schema, pathGlobFilter="events.parquet")


def _transaction_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _event_stream(spark, sf_dir)
    return spark.sql(inputs._SPARK_VIEW.replace("FROM events", "FROM {events}"), events=stream)


def _run_to_table(spark: SparkSession, stream: DataFrame, label: str, mode: str) -> DataFrame:
    folder = scratch_dir(spark, label)

    def keep(batch: DataFrame, batch_id: int) -> None:
        router.write_batch(batch, f"{folder}/rows", batch_id)

    started = (stream.writeStream.foreachBatch(keep).outputMode(mode)
               .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    started.awaitTermination()
    # With its schema, as a stream without results has written no file to infer it from.
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("micro_batch", T.LongType())])).parquet(f"{folder}/rows")


@query("streamed_behavioral_features", f"""WITH {CTE_BEHAVIOR}
SELECT event_id, {_rounded_sql(BEHAVIOR_FEATURES)} FROM feat""")
def streamed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    stateful.use_rocksdb(spark)
    valid = validate_transactions(_transaction_stream(spark, sf_dir)).drop("ts")
    out = _run_to_table(spark, stateful.behavioral_stream(valid), "behavior", "update")
    return out.select("event_id", *_rounded(BEHAVIOR_FEATURES))


def _formula_decider(rows: DataFrame) -> DataFrame:
    """The fixed scores that the batch decisions are made of too."""
    return decide(assign_tiers(rows.withColumns({"anomaly_score": F.expr(inputs._SCORE), "second_stage_probability": F.expr(inputs._STAGE_TWO)})))


def _decision_job(spark: SparkSession, stream: DataFrame, history: DataFrame | None = None) -> str:
    """Run the streaming decision job to the end of its source; the folder of its outputs."""
    stateful.use_rocksdb(spark)
    folder = scratch_dir(spark, "decisions")
    features = decisions.feature_stream(stream.drop("ts"), history=history)
    decisions.start_decisions(features, _formula_decider, folder, f"{folder}/checkpoint", available_now=True).awaitTermination()
    return folder


@query("streamed_final_decisions", f"""WITH {CTE_DECIDED}
SELECT transaction_id, risk_level, xgboost_probability, xgboost_prediction::DOUBLE AS xgboost_prediction,
  final_prediction, final_decision_path, final_risk_action FROM decided""")
def streamed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job on a stream: the same decisions as in batch."""
    folder = _decision_job(spark, _transaction_stream(spark, sf_dir))
    return decisions.committed(spark, folder, "decisions").select(
        "transaction_id", "risk_level", "xgboost_probability", F.col("xgboost_prediction").cast("double"),
        "final_prediction", "final_decision_path", "final_risk_action")


@query("streamed_decision_ledger", f"""WITH {CTE_DECIDED}
SELECT (SELECT count(*) FROM tx)::BIGINT AS records, (SELECT count(*) FROM tx)::BIGINT - count(*) AS rejects, count(*) AS total,
  count(*) FILTER (risk_level IN ('L1', 'L2')) AS second_stage_input, count(*) FILTER (risk_level IN ('L3', 'L4', 'L5')) AS direct_alerts,
  count(*) FILTER (risk_level IN ('L1', 'L2') AND xgboost_prediction = 1) AS second_stage_alerts,
  count(*) FILTER (risk_level IN ('L1', 'L2') AND xgboost_prediction IS DISTINCT FROM 1) AS low_risk,
  count(*) AS messages FROM decided""")
def streamed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that the decision job wrote, summed over its micro-batches, and the messages that it published."""
    folder = _decision_job(spark, _transaction_stream(spark, sf_dir))
    names = ["records", "rejects", "total", "second_stage_input", "direct_alerts", "second_stage_alerts", "low_risk"]
    sent = decisions.committed(spark, folder, "messages").groupBy("micro_batch").agg(F.count("*").alias("messages"))
    ledger = spark.read.parquet(f"{folder}/ledger").join(sent, "micro_batch", "left")
    return ledger.agg(*(F.sum(c).alias(c) for c in names), F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"))


@query("streamed_features_with_history", f"""WITH {CTE_BEHAVIOR}
SELECT event_id, {_rounded_sql(BEHAVIOR_FEATURES)} FROM feat WHERE step > (SELECT max(step) // 2 FROM valid)""")
def streamed_with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later steps as a stream that starts from the state of the earlier ones."""
    stateful.use_rocksdb(spark)
    valid = inputs.valid_transactions(spark, sf_dir)
    half = valid.agg(F.max("step")).first()[0] // 2
    folder = scratch_dir(spark, "history")
    stateful.state_history(valid.where(F.col("step") <= half)).write.parquet(folder)
    later = validate_transactions(_transaction_stream(spark, sf_dir)).drop("ts").where(F.col("step") > half)
    out = _run_to_table(spark, stateful.behavioral_stream(later, history=spark.read.parquet(folder)), "behavior", "update")
    return out.select("event_id", *_rounded(BEHAVIOR_FEATURES))


_STREAM_SCORE = "round(0.03 * log_amount - 0.06, 6)"


@query("streamed_routes", f"""WITH {CTE_BASE}, s AS (SELECT transaction_id, type, {_STREAM_SCORE} AS score FROM base), t AS (
SELECT transaction_id, CASE WHEN score >= {DEFAULT_THRESHOLDS['T2']!r} OR type = 'TRANSFER' THEN 'fraud-alerts' ELSE 'low-risk' END AS route
FROM s) SELECT transaction_id AS key, route FROM t""")
def streamed_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "router")

    def formula(batch: DataFrame) -> DataFrame:
        scored = base_features(batch).withColumns({
            "anomaly_score": F.expr(_STREAM_SCORE),
            "second_stage_probability": F.when(F.col("type") == "TRANSFER", 0.95).otherwise(0.05)})
        return decide(assign_tiers(scored))

    started = router.start_router(_transaction_stream(spark, sf_dir), formula, folder, f"{folder}/checkpoint", available_now=True)
    started.awaitTermination()
    return spark.read.parquet(f"{folder}/messages").select("key", "route")


@query("streamed_alert_intake", f"""WITH {CTE_TX}
SELECT CASE WHEN event_id % 50 = 7 THEN 'dead_letter' ELSE 'handled' END AS outcome, count(*) AS n FROM tx GROUP BY 1""")
def streamed_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "intake")
    source = f"{folder}/source"
    raw = raw_events(spark, sf_dir)
    raw.write.parquet(source)

    def handle(batch: DataFrame, batch_id: int) -> None:
        router.write_batch(batch.select("offset"), f"{folder}/handled", batch_id)

    started = (readers.file_events(spark, source, raw.schema).writeStream
               .foreachBatch(router.alert_intake(handle, folder)).option("checkpointLocation", f"{folder}/checkpoint")
               .trigger(availableNow=True).start())
    started.awaitTermination()
    handled = spark.read.parquet(f"{folder}/handled").select(F.lit("handled").alias("outcome"))
    rejected = spark.read.parquet(f"{folder}/dead_letters").select(F.lit("dead_letter").alias("outcome"))
    return handled.unionByName(rejected).groupBy("outcome").agg(F.count("*").alias("n"))


# Rules on a stream: a component without an event for an hour, and three failures in an hour that hold for ten minutes.
_RULES = {"silent": {"length": 60, "at_most": 0}, "failing": {"length": 60, "at_least": 3, "hold": 10}}
CTE_ALERTS = """final AS (SELECT date_trunc('minute', max(ts) - INTERVAL 10 MINUTE) - INTERVAL 1 MINUTE AS until FROM events), seen AS (
SELECT 'silent' AS rule, event_type AS component, date_trunc('minute', ts) AS m FROM events UNION ALL
SELECT 'failing', event_type, date_trunc('minute', ts) FROM events WHERE value < 3), per AS (
SELECT rule, component, m, count(*) AS n FROM seen GROUP BY ALL), spine AS (
SELECT rule, component, unnest(generate_series(min(m), any_value(until), INTERVAL 1 MINUTE)) AS m FROM per, final GROUP BY 1, 2), slid AS (
SELECT rule, component, m, sum(coalesce(n, 0)) OVER (PARTITION BY rule, component ORDER BY m ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS n
FROM spine LEFT JOIN per USING (rule, component, m)), act AS (
SELECT *, m - row_number() OVER (PARTITION BY rule, component ORDER BY m) * INTERVAL 1 MINUTE AS island FROM slid
WHERE (rule = 'silent' AND n = 0) OR (rule = 'failing' AND n >= 3)), spans AS (
SELECT rule, component, min(m) AS since, max(m) AS last, CASE rule WHEN 'failing' THEN 600 ELSE 0 END AS hold FROM act GROUP BY rule, component, island),
alerts AS (SELECT rule, component, epoch(since)::BIGINT AS active_since, (epoch(since) + hold)::BIGINT AS firing_from,
  CASE WHEN last < until THEN epoch(last)::BIGINT END AS active_until FROM spans, final WHERE epoch(last) >= epoch(since) + hold)"""


def _rule_rows(stream_or_table: DataFrame) -> DataFrame:
    return stream_or_table.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("component"), "value")


def _alert_epochs(df: DataFrame, rule: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), "component", *[F.unix_timestamp(c).alias(c) for c in ("active_since", "firing_from", "active_until")])


def _wanted(rule: str):
    return F.col("value") < 3 if rule == "failing" else None


@query("alert_spans", f"WITH {CTE_ALERTS} SELECT * FROM alerts")
def alert_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rule_rows(table(spark, sf_dir, "events"))
    newest = rows.agg(F.max("ts")).first()[0]
    until = F.date_trunc("minute", F.lit(newest).cast("timestamp") - F.expr("INTERVAL 10 MINUTES")) - F.expr("INTERVAL 1 MINUTE")
    parts = [_alert_epochs(monitor.alert_spans(rows, ["component"], until, wanted=_wanted(rule), **limits), rule) for rule, limits in _RULES.items()]
    return parts[0].unionByName(parts[1])


@query("streamed_alert_spans", f"WITH {CTE_ALERTS} SELECT * FROM alerts")
def streamed_alert_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same alerts from timers of the streaming job."""
    stateful.use_rocksdb(spark)
    parts = []
    for rule, limits in _RULES.items():
        stream = alerts.alert_stream(_rule_rows(_event_stream(spark, sf_dir)), ["component"], wanted=_wanted(rule), **limits)
        parts.append(_alert_epochs(alerts.alert_states(_run_to_table(spark, stream, "alerts", "append"), ["component"]), rule))
    return parts[0].unionByName(parts[1])


@query("streamed_unique_events", "SELECT count(DISTINCT event_id) AS n FROM events")
def streamed_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    stateful.use_rocksdb(spark)
    stream = _event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    doubled = stream.select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    out = _run_to_table(spark, router.deduplicated_stream(doubled, "event_id", "ts"), "unique", "append")
    return out.agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- models

def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base_features(inputs.valid_transactions(spark, sf_dir))
    return cascade.Scaler.fit(df.where("isFraud = 0"), BASE_FEATURES).transform(df)


_Z = ", ".join(f"""("{f}"::DOUBLE - (SELECT avg("{f}"::DOUBLE) FROM legit)) / coalesce(nullif((SELECT stddev_pop("{f}"::DOUBLE) FROM legit), 0), 1)
  AS "z_{f}\"""" for f in BASE_FEATURES)
CTE_SCALED = CTE_BASE + f", legit AS (SELECT * FROM base WHERE isFraud = 0), scaled AS (SELECT *, {_Z} FROM base)"


@query("standardized_features", f"""WITH {CTE_SCALED}
SELECT event_id, {_rounded_sql([f"z_{f}" for f in BASE_FEATURES], 5)} FROM scaled""")
def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir).select("event_id", *_rounded([f"z_{f}" for f in BASE_FEATURES], 5))


_ENTRIES = ", ".join(f"""{{'o': -round(abs("z_{f}"), 6), 'n': '{f}'}}""" for f in BASE_FEATURES)


@query("top_contributing_features", f"""WITH {CTE_SCALED}
SELECT event_id, array_to_string(list_transform(list_sort([{_ENTRIES}])[1:3], lambda e: e.n), ',') AS top_features FROM scaled""")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = _scaled(spark, sf_dir).withColumns({f"z_{f}": F.round(f"z_{f}", 6) for f in BASE_FEATURES})
    names = F.transform(cascade.top_contributions(BASE_FEATURES), lambda t: F.substring_index(t, " (", 1))
    return rounded.select("event_id", F.array_join(names, ",").alias("top_features"))


@query("record_verdicts", f"""WITH {CTE_SCALED}, s AS (SELECT *, {_STREAM_SCORE} AS score FROM scaled)
SELECT event_id, CASE WHEN score < {DEFAULT_THRESHOLDS['T1']!r} THEN 'L1' WHEN score < {DEFAULT_THRESHOLDS['T2']!r} THEN 'L2'
  WHEN score < {DEFAULT_THRESHOLDS['T3']!r} THEN 'L3' WHEN score < {DEFAULT_THRESHOLDS['T4']!r} THEN 'L4' ELSE 'L5' END AS risk_level,
  score >= 0.02 AS is_anomaly, CASE WHEN score >= {DEFAULT_THRESHOLDS['T3']!r} THEN 'Immediate Escalation / Audit'
  WHEN score >= {DEFAULT_THRESHOLDS['T2']!r} THEN 'Sampled Review' ELSE 'Automated Pass' END AS recommended_action FROM s""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scaled(spark, sf_dir).withColumn("anomaly_score", F.expr(_STREAM_SCORE))
    return cascade.record_verdicts(scored, BASE_FEATURES, DEFAULT_THRESHOLDS, 0.02).select(
        "event_id", "risk_level", "is_anomaly", "recommended_action")


def _forest_scored(spark: SparkSession, sf_dir: str, trees: int = 100) -> DataFrame:
    df = inputs.featured(spark, sf_dir)
    nodes = forest.train_forest(df.where("isFraud = 0"), MODEL_FEATURES, "event_id", trees)
    return forest.score_forest(df, forest.Forest.load(nodes, MODEL_FEATURES))


@query("isolation_forest_scores")
def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forest_scored(spark, sf_dir).select("event_id", "isFraud", F.round("anomaly_score", 9).alias("anomaly_score"))


@query("isolation_forest_checks", f"""WITH {CTE_TX}
SELECT isFraud, count(*) AS rows, count(*) AS in_range FROM valid GROUP BY isFraud""")
def forest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is scored once and every score lies inside the open range."""
    inside = (F.col("anomaly_score") > -0.5) & (F.col("anomaly_score") < 0.5)
    return _forest_scored(spark, sf_dir, 30).groupBy("isFraud").agg(
        F.count("*").alias("rows"), F.count_if(inside).alias("in_range"))


@query("isolation_forest_nodes")
def forest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base_features(inputs.valid_transactions(spark, sf_dir)).where("isFraud = 0")
    return forest.train_forest(df, BASE_FEATURES, "event_id", 20)


@query("isolation_forest_search")
def forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = inputs.valid_transactions(spark, sf_dir)
    df = base_features(valid).withColumn("split", splits.chronological_label(valid))
    found = cascade.forest_search(
        df.where("split = 'train'"), df.where("split = 'validation'"), BASE_FEATURES, "event_id",
        [{"trees": 20, "subsample": 128}, {"trees": 40, "subsample": 256}])
    return spark.createDataFrame(
        [(i, r["trees"], r["subsample"], float(r["threshold"]), float(r["f1"])) for i, r in enumerate(found)],
        "place int, trees int, subsample int, threshold double, f1 double")


@query("second_stage_decisions")
def second_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the low tiers of the training split, decide the whole table."""
    label = splits.chronological_label(inputs.valid_transactions(spark, sf_dir))
    df = assign_tiers(inputs.scored(spark, sf_dir).drop("second_stage_probability")).withColumn("split", label)
    low = df.where("risk_level IN ('L1', 'L2')")
    stage, _ = cascade.train_second_stage(
        low.where("split = 'train'"), low.where("split = 'validation'"), [*MODEL_FEATURES, "anomaly_score"],
        configs=[{"maxDepth": 3, "stepSize": 0.1, "maxIter": 8}])
    return decide(stage.apply(df), threshold=stage.threshold).select(
        "event_id", "risk_level", F.round("xgboost_probability", 6).alias("xgboost_probability"), "final_prediction",
        "final_decision_path")


@query("reconstruction_errors")
def reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base_features(inputs.valid_transactions(spark, sf_dir))
    out = cascade.reconstruction_error(df.where("isFraud = 0"), df, BASE_FEATURES, k=6)
    return out.select("event_id", F.round("reconstruction_error", 6).alias("reconstruction_error"))


@query("full_rank_reconstruction", f"""WITH {CTE_TX} SELECT count(*) AS rows, count(*) AS exact FROM valid""")
def full_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With as many axes as features nothing is lost."""
    columns = ["amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest", "log_amount"]
    df = base_features(inputs.valid_transactions(spark, sf_dir))
    out = cascade.reconstruction_error(df.where("isFraud = 0"), df, columns, k=len(columns))
    return out.agg(F.count("*").alias("rows"), F.count_if(F.col("reconstruction_error") < 1e-9).alias("exact"))


@query("approximate_tier_thresholds")
def approximate_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.approximate_tier_thresholds(inputs.scored(spark, sf_dir), "anomaly_score", "isFraud")


