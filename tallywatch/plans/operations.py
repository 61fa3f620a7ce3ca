"""Queries: control-plane reporting and monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywatch.functions.ids import uuid5_url
from tallywatch.operators import control, monitor, validate
from tallywatch.plans import inputs
from tallywatch.plans.inputs import CTE_TX
from tallywatch.plans.pipeline import _UUID5, UUID5_HASH
from tallywatch.plans.registry import query, table

_LEDGER = """SELECT transaction_id, event_id, concat('B', CAST(event_id // 500 AS {text})) AS batch_id,
  CAST(event_id % 500 AS INT) AS sequence_number, ts AS generated_at, type, amount, nameOrig, nameDest, isFraud,
  CASE WHEN event_id % 17 = 0 THEN 'FAILED' ELSE 'SENT' END AS kafka_status,
  CASE WHEN amount < 0 THEN 'PENDING' WHEN amount >= 20 THEN 'FRAUD_ALERT' ELSE 'LOW_RISK' END AS processing_status,
  CASE WHEN amount < 5 THEN 'L1' WHEN amount < 20 THEN 'L2' WHEN amount < 50 THEN 'L3' WHEN amount < 100 THEN 'L4'
    ELSE 'L5' END AS risk_level,
  CASE WHEN amount < 0 THEN NULL WHEN amount >= 20 THEN 'FRAUD_ALERT' ELSE 'LOW_RISK' END AS final_decision,
  CASE WHEN amount >= 20 THEN 1 ELSE 0 END AS final_prediction,
  CASE WHEN amount >= 20 THEN {alert} END AS alert_id,
  CASE WHEN amount < 20 THEN 'NOT_APPLICABLE' WHEN event_id % 5 = 0 THEN 'COMPLETED' WHEN event_id % 5 = 1 THEN 'PARTIAL'
    WHEN event_id % 5 = 2 THEN 'INSUFFICIENT_EVIDENCE' WHEN event_id % 5 = 3 THEN 'FAILED' ELSE 'PENDING' END
    AS investigation_status
FROM {source}"""
CTE_LEDGER = f"{CTE_TX}, hashed AS (SELECT *, {UUID5_HASH} AS h FROM tx), ledger AS (" + _LEDGER.format(
    text="VARCHAR", alert=_UUID5, source="hashed") + """), batches AS (
SELECT batch_id, count(*) AS requested_count, count(*) AS generated_count,
  count(*) FILTER (kafka_status = 'SENT') AS sent_count, count(*) FILTER (kafka_status = 'FAILED') AS failed_count,
  min(generated_at) AS created_at FROM ledger GROUP BY batch_id)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control-plane transactions over the transaction view, 500 per batch."""
    alert = uuid5_url(F.concat(F.lit("fraud-alert:"), F.col("transaction_id")))
    source = inputs.transactions(spark, sf_dir).withColumn("derived_alert", alert)
    text = _LEDGER.format(text="STRING", alert="derived_alert", source="{source}").replace(
        "event_id // 500", "event_id DIV 500")
    return spark.sql(text, source=source)


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    return rows.groupBy("batch_id").agg(
        F.count("*").alias("requested_count"), F.count("*").alias("generated_count"),
        F.count_if(F.col("kafka_status") == "SENT").alias("sent_count"),
        F.count_if(F.col("kafka_status") == "FAILED").alias("failed_count"), F.min("generated_at").alias("created_at"))


@query("batch_counts", f"""WITH {CTE_LEDGER}
SELECT batch_id, count(*) FILTER (processing_status IN ('FRAUD_ALERT','LOW_RISK')) AS processed,
  count(*) FILTER (processing_status = 'FRAUD_ALERT') AS fraud_alerts,
  count(*) FILTER (processing_status = 'LOW_RISK') AS low_risk,
  count(*) FILTER (alert_id IS NOT NULL) AS investigation_requests,
  count(*) FILTER (investigation_status IN ('COMPLETED','PARTIAL','INSUFFICIENT_EVIDENCE')) AS investigations_completed,
  count(*) FILTER (investigation_status = 'COMPLETED') AS investigations_succeeded,
  count(*) FILTER (investigation_status IN ('PARTIAL','INSUFFICIENT_EVIDENCE')) AS investigations_partial,
  count(*) FILTER (investigation_status = 'PENDING' AND alert_id IS NOT NULL) AS investigations_pending,
  count(*) FILTER (investigation_status = 'FAILED') AS investigations_failed FROM ledger GROUP BY batch_id""")
def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.batch_counts(ledger(spark, sf_dir))


_SUMMARY = """SELECT (SELECT sum(requested_count)::BIGINT FROM batches) AS requested,
  (SELECT sum(generated_count)::BIGINT FROM batches) AS generated, (SELECT sum(sent_count)::BIGINT FROM batches) AS sent,
  (SELECT sum(failed_count)::BIGINT FROM batches) AS failed, count(*) AS processed,
  count(*) FILTER (processing_status = 'FRAUD_ALERT') AS fraud_alerts,
  count(*) FILTER (processing_status = 'LOW_RISK') AS low_risk, count(*) FILTER (alert_id IS NOT NULL) AS investigations,
  count(*) FILTER (investigation_status = 'PENDING' AND alert_id IS NOT NULL) AS investigation_pending,
  count(*) FILTER (investigation_status IN ('COMPLETED','PARTIAL','INSUFFICIENT_EVIDENCE')) AS investigation_success,
  count(*) FILTER (investigation_status = 'FAILED') AS investigation_failed
FROM ledger WHERE processing_status IN ('FRAUD_ALERT','LOW_RISK')"""


@query("control_summary", f"WITH {CTE_LEDGER} {_SUMMARY}")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.global_summary(batches(spark, sf_dir), ledger(spark, sf_dir))


@query("ledger_page", f"""WITH {CTE_LEDGER}
SELECT transaction_id, amount, risk_level, (SELECT count(*) FROM ledger WHERE kafka_status = 'SENT'
  AND alert_id IS NOT NULL) AS total FROM ledger WHERE kafka_status = 'SENT' AND alert_id IS NOT NULL
ORDER BY amount DESC, sequence_number, transaction_id LIMIT 25 OFFSET 50""")
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = validate.search_predicate(kafka_status="SENT", investigation_status="ALL")
    items, total = control.ledger_page(ledger(spark, sf_dir), rule, page=3, sort_by="amount")
    return items.select("transaction_id", "amount", "risk_level", F.lit(total).cast("long").alias("total"))


@query("batch_progress_and_status", f"""WITH {CTE_LEDGER}
SELECT batch_id, least(100.0, round(100 * sent_count / requested_count, 1))::DOUBLE AS progress,
  CASE WHEN sent_count = requested_count AND failed_count = 0 THEN 'COMPLETED' WHEN sent_count > 0 THEN 'PARTIAL'
    ELSE 'FAILED' END AS status FROM batches""")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches(spark, sf_dir).select(
        "batch_id", control.progress_pct(F.col("sent_count"), F.col("requested_count")).alias("progress"),
        control.final_batch_status(F.lit(False)).alias("status"))


@query("recent_batches", f"""WITH {CTE_LEDGER}
SELECT batch_id, sent_count FROM batches ORDER BY created_at DESC, batch_id DESC LIMIT 5""")
def recent_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.recent(batches(spark, sf_dir), ["created_at", "batch_id"], 5).select("batch_id", "sent_count")


@query("bounded_activity_log", """SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 10000""")
def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.bounded_log(table(spark, sf_dir, "events").select("event_id", "event_type"))


@query("merged_decisions", f"""WITH {CTE_LEDGER}, d AS (
SELECT transaction_id, event_id AS o, 'low' AS topic, 'L1' AS risk_level, NULL AS action FROM ledger
UNION ALL SELECT transaction_id, event_id + 10000000, 'fraud', 'L4', 'PRIORITY_INVESTIGATE' FROM ledger WHERE amount >= 60
UNION ALL SELECT concat('GHOST-', event_id), event_id, 'fraud', 'L5', NULL FROM ledger), n AS (
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY o DESC) = 1)
SELECT l.transaction_id, CASE WHEN topic = 'fraud' THEN 'FRAUD_ALERT' ELSE 'LOW_RISK' END AS processing_status,
  n.risk_level, coalesce(action, CASE WHEN topic = 'fraud' THEN 'FRAUD_ALERT' ELSE 'LOW_RISK' END) AS final_decision,
  CASE WHEN topic = 'fraud' THEN 'PENDING' ELSE 'NOT_APPLICABLE' END AS investigation_status,
  CASE WHEN topic = 'fraud' THEN l.alert_id END AS alert_id FROM ledger l JOIN n USING (transaction_id)""")
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)

    def decision(df: DataFrame, identity, offset, topic: str, level: str, action: str | None) -> DataFrame:
        none = F.lit(None)
        return df.select(
            identity.alias("transaction_id"), offset.alias("offset"), F.lit(topic).alias("topic"),
            F.lit(level).alias("risk_level"), none.cast("double").alias("anomaly_score"),
            none.cast("double").alias("xgboost_probability"), none.cast("int").alias("xgboost_prediction"),
            F.lit(1 if topic == "fraud" else 0).alias("final_prediction"), none.cast("string").alias("final_decision_path"),
            F.lit(action).cast("string").alias("final_risk_action"))

    first = decision(rows, F.col("transaction_id"), F.col("event_id"), "low", "L1", None)
    later = decision(rows.where("amount >= 60"), F.col("transaction_id"), F.col("event_id") + 10_000_000, "fraud", "L4",
                     "PRIORITY_INVESTIGATE")
    ghosts = decision(rows, F.concat(F.lit("GHOST-"), "event_id"), F.col("event_id"), "fraud", "L5", None)
    out = control.merge_decisions(rows, first.unionByName(later).unionByName(ghosts))
    return out.select("transaction_id", "processing_status", "risk_level", "final_decision", "investigation_status",
                      "alert_id")


_REQUESTS = """SELECT o_orderkey AS request_id, concat('K', o_custkey) AS idempotency_key, o_orderpriority AS request_hash,
  o_orderdate AS requested_at FROM orders"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.concat(F.lit("K"), F.col("o_custkey")).alias("idempotency_key"),
        F.col("o_orderpriority").alias("request_hash"), F.col("o_orderdate").alias("requested_at"))


@query("idempotent_requests", f"""WITH r AS ({_REQUESTS}), f AS (
SELECT *, first_value(request_id) OVER w AS first_id, first_value(request_hash) OVER w AS first_hash FROM r
WINDOW w AS (PARTITION BY idempotency_key ORDER BY requested_at, request_id))
SELECT request_id, first_id AS effective_request_id, CASE WHEN request_id = first_id THEN 'created'
  WHEN request_hash = first_hash THEN 'existing' ELSE 'conflict' END AS outcome FROM f""")
def idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.batch_requests(_requests(spark, sf_dir)).select("request_id", "effective_request_id", "outcome")


@query("conflicting_request_keys", f"""WITH r AS ({_REQUESTS})
SELECT idempotency_key, count(*) AS requests, count(DISTINCT request_hash) AS bodies FROM r GROUP BY 1
HAVING count(DISTINCT request_hash) > 1""")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.conflicting_keys(_requests(spark, sf_dir))


@query("dashboard_bundle", f"""WITH {CTE_LEDGER}, b AS (
SELECT batch_id FROM batches ORDER BY created_at DESC, batch_id DESC LIMIT 5), t AS (
SELECT transaction_id FROM ledger ORDER BY generated_at DESC, transaction_id DESC LIMIT 8), a AS (
SELECT event_id FROM ledger ORDER BY event_id DESC LIMIT 12), s AS ({_SUMMARY})
SELECT processed, fraud_alerts, (SELECT string_agg(batch_id, ',' ORDER BY batch_id) FROM b) AS batches,
  (SELECT string_agg(transaction_id, ',' ORDER BY transaction_id) FROM t) AS transactions,
  (SELECT string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FROM a) AS activity FROM s""")
def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    listed = batches(spark, sf_dir).withColumns({
        "status": control.final_batch_status(F.lit(False)),
        "progress": control.progress_pct(F.col("generated_count"), F.col("requested_count"))})
    log = rows.select("event_id", F.lit("transaction_generated").alias("event_type"), "batch_id")
    out = control.dashboard(listed, rows, log)
    return out.select(
        "summary.processed", "summary.fraud_alerts",
        F.array_join(F.array_sort("recent_batches.batch_id"), ",").alias("batches"),
        F.array_join(F.array_sort("recent_transactions.transaction_id"), ",").alias("transactions"),
        F.array_join(F.array_sort("recent_activity.event_id"), ",").alias("activity"))


_TIERS_SQL = ", ".join(f"count(*) FILTER (risk_level = 'L{i}') AS L{i}_rows" for i in range(1, 6))


@query("ground_truth_report", f"""WITH {CTE_LEDGER}, c AS (SELECT
  count(*) FILTER (isFraud = 1 AND final_prediction = 1) AS tp, count(*) FILTER (isFraud = 0 AND final_prediction = 1) AS fp,
  count(*) FILTER (isFraud = 1 AND final_prediction = 0) AS fn, count(*) FILTER (isFraud = 0 AND final_prediction = 0) AS tn,
  count(*) FILTER (processing_status <> 'PENDING') AS processed, count(*) AS rows,
  count(*) FILTER (processing_status = 'FRAUD_ALERT') AS alerts, {_TIERS_SQL} FROM ledger)
SELECT *, round(100.0 * tp / (tp + fp), 6)::DOUBLE AS precision_pct, round(100.0 * tp / (tp + fn), 6)::DOUBLE AS recall_pct,
  round(200.0 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1_pct, round(100.0 * alerts / processed, 6)::DOUBLE AS alert_rate_pct,
  {', '.join(f"round(100.0 * L{i}_rows / rows, 6)::DOUBLE AS L{i}_pct" for i in range(1, 6))} FROM c""")
def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = control.ground_truth_report(ledger(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_pct")})


@query("message_sequence", """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)
  AS sequence_number FROM conversations""")
def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.message_sequence(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"),
                                    "conv_id", "turn")


@query("conversation_window", """SELECT conv_id, turn, role, substr(text, 1, 800) AS text FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10""")
def conversation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.latest_messages(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two results per investigated alert, none for the highest tier; only the newer one counts."""
    rows = ledger(spark, sf_dir).where("alert_id IS NOT NULL AND risk_level <> 'L5'")
    return rows.select("alert_id", F.inline(F.array(
        F.struct((F.col("event_id") * 10).alias("generated_at"), F.concat(F.lit("INV-a-"), "event_id").alias("investigation_id"),
                 F.lit("failed").alias("investigation_status")),
        F.struct((F.col("event_id") * 10 + 1).alias("generated_at"),
                 F.concat(F.lit("INV-b-"), "event_id").alias("investigation_id"),
                 F.when(F.col("event_id") % 2 == 0, "completed").alias("investigation_status")))))


@query("alerts_not_yet_investigated", f"""WITH {CTE_LEDGER}
SELECT alert_id, transaction_id FROM ledger WHERE alert_id IS NOT NULL AND risk_level = 'L5'""")
def not_investigated(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = ledger(spark, sf_dir).where("alert_id IS NOT NULL").select("alert_id", "transaction_id")
    return control.not_yet_investigated(alerts, _results(spark, sf_dir))


@query("updated_pending_alerts", f"""WITH {CTE_LEDGER}
SELECT transaction_id, CASE WHEN investigation_status = 'PENDING' AND alert_id IS NOT NULL AND risk_level <> 'L5'
    THEN CASE WHEN event_id % 2 = 0 THEN 'COMPLETED' ELSE 'FAILED' END ELSE investigation_status END AS investigation_status,
  CASE WHEN investigation_status = 'PENDING' AND alert_id IS NOT NULL AND risk_level <> 'L5'
    THEN concat('INV-b-', event_id) END AS investigation_id FROM ledger""")
def updated_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = control.update_pending(ledger(spark, sf_dir), _results(spark, sf_dir))
    return out.select("transaction_id", "investigation_status", "investigation_id")


CTE_SAMPLES = """samples AS (SELECT event_id, ts, date_trunc('minute', ts) AS minute, event_type AS component,
  CASE WHEN value < 3 THEN 'failure' ELSE 'success' END AS status, value AS duration FROM events), slid AS (
SELECT *, minute - k * INTERVAL 1 MINUTE AS s5 FROM samples, range(5) r(k))"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("component"),
        F.when(F.col("value") < 3, "failure").otherwise("success").alias("status"), F.col("value").alias("duration"))


def _epoch(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.unix_timestamp(c) for c in columns})


@query("event_rates", f"""WITH {CTE_SAMPLES}
SELECT component, status, epoch(s5)::BIGINT AS window_start, count(*) AS n, round(count(*) / 300.0, 9)::DOUBLE AS per_second
FROM slid GROUP BY 1, 2, 3""")
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitor.event_rates(samples(spark, sf_dir), ["component", "status"]).drop("window_end")
    return _epoch(out, "window_start").withColumn("per_second", F.round("per_second", 9))


@query("failure_ratio", f"""WITH {CTE_SAMPLES}
SELECT epoch(s5)::BIGINT + 300 AS window_end, count(*) FILTER (status = 'failure') AS hits, count(*) AS n,
  round(count(*) FILTER (status = 'failure') / 300.0 / greatest(count(*) / 300.0, 0.001), 9)::DOUBLE AS ratio
FROM slid GROUP BY s5""")
def failure_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitor.status_ratio(samples(spark, sf_dir), F.col("status") == "failure")
    return _epoch(out, "window_end").withColumn("ratio", F.round("ratio", 9))


@query("duration_p95", f"""WITH {CTE_SAMPLES}
SELECT component, round(quantile_cont(duration, 0.95), 6) AS quantile, count(*) AS n FROM samples GROUP BY component""")
def p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.duration_quantile(samples(spark, sf_dir), "duration", 0.95, ["component"]).withColumn(
        "quantile", F.round("quantile", 6))


_BOUNDS = [1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0]
_EDGES = ", ".join(f"({low!r}::DOUBLE, {high!r}::DOUBLE)" for low, high in zip([0.0, *_BOUNDS], _BOUNDS))


@query("histogram_quantile_p95", f"""WITH {CTE_SAMPLES}, e AS (
SELECT * FROM (VALUES {_EDGES}, (100.0::DOUBLE, 'inf'::DOUBLE)) v(lo, le)), h AS (
SELECT component, lo, le, count(*) FILTER (duration <= le AND (duration > lo OR lo = 0)) AS n,
  count(*) FILTER (duration <= lo AND lo > 0) AS below, count(*) AS total FROM samples, e GROUP BY ALL)
SELECT component, round(CASE WHEN isinf(le) THEN 100.0 ELSE lo + (le - lo) * (0.95 * total - below) / n END, 6) AS quantile,
  total AS n FROM h WHERE below < 0.95 * total AND 0.95 * total <= below + n""")
def histogram_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = monitor.bucket_counts(samples(spark, sf_dir), "duration", ["component"], _BOUNDS)
    return monitor.histogram_quantile(counts, 0.95, ["component"], _BOUNDS).withColumn(
        "quantile", F.round("quantile", 6))


@query("silent_minutes", f"""WITH {CTE_SAMPLES}, spine AS (
SELECT unnest(generate_series((SELECT min(minute) FROM samples), (SELECT max(minute) FROM samples), INTERVAL 1 MINUTE)) AS m),
c AS (SELECT m, count(event_id) AS n FROM spine LEFT JOIN samples ON minute = m GROUP BY m)
SELECT epoch(m)::BIGINT AS minute FROM c
WINDOW w AS (ORDER BY m ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) QUALIFY sum(n) OVER w = 0 AND count(*) OVER w = 10""")
def silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _epoch(monitor.silent_minutes(samples(spark, sf_dir)), "minute")


@query("firing_spans", f"""WITH {CTE_SAMPLES}, a AS (
SELECT DISTINCT component, date_trunc('hour', ts) AS h FROM samples WHERE status = 'failure'), g AS (
SELECT *, h - row_number() OVER (PARTITION BY component ORDER BY h) * INTERVAL 1 HOUR AS island FROM a)
SELECT component, epoch(min(h))::BIGINT AS active_since, epoch(min(h))::BIGINT + 7200 AS firing_from,
  epoch(max(h))::BIGINT AS active_until FROM g GROUP BY component, island
HAVING epoch(max(h)) >= epoch(min(h)) + 7200""")
def firing(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = samples(spark, sf_dir).where("status = 'failure'")
    states = monitor.per_minute(failed, ["component"], grain="hour").withColumn("active", F.col("n") > 0)
    out = monitor.firing_spans(states, ["component"], "active", hold=120, every=60)
    return _epoch(out, "active_since", "firing_from", "active_until")


@query("repeated_failures", f"""WITH {CTE_SAMPLES}, slid60 AS (
SELECT *, minute - k * INTERVAL 1 MINUTE AS s60 FROM samples, range(60) r(k) WHERE status = 'failure')
SELECT component, epoch(s60)::BIGINT AS window_start, count(*) AS n FROM slid60 GROUP BY component, s60
HAVING count(*) >= 3""")
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitor.repeated_failures(samples(spark, sf_dir), F.col("status") == "failure", ["component"], length=60)
    return _epoch(out.drop("window_end"), "window_start")


@query("gauge_changes", f"""WITH {CTE_SAMPLES}, p AS (SELECT event_id, component, status,
  lag(status) OVER (PARTITION BY component ORDER BY event_id) AS previous FROM samples)
SELECT * FROM p WHERE previous IS NOT NULL AND previous <> status""")
def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir).select("event_id", "component", "status")
    return monitor.gauge_changes(df, ["component"], "status", "event_id", F.floor(F.col("event_id") / 1000))


@query("availability", f"""WITH {CTE_SAMPLES}
SELECT component, round(avg((status = 'success')::INT), 9) AS availability, count(*) AS samples FROM samples GROUP BY 1""")
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = samples(spark, sf_dir).withColumn("up", F.col("status") == "success")
    return monitor.availability(df.withColumn("up", F.col("up").cast("int")), "up", ["component"]).withColumn(
        "availability", F.round("availability", 9))


@query("counter_increase", f"""WITH {CTE_SAMPLES}, m AS (
SELECT component, minute, count(*) AS n FROM samples GROUP BY 1, 2), c AS (
SELECT component, epoch(minute)::BIGINT AS seen_at,
  (sum(n) OVER (PARTITION BY component, date_trunc('day', minute) ORDER BY minute))::BIGINT AS total FROM m), p AS (
SELECT *, lag(total) OVER (PARTITION BY component ORDER BY seen_at) AS earlier FROM c)
SELECT component, seen_at, total, (CASE WHEN earlier IS NULL THEN NULL WHEN total < earlier THEN total ELSE total - earlier END)::DOUBLE
  AS increase FROM p""")
def increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    minutes = monitor.per_minute(samples(spark, sf_dir), ["component"])
    day = Window.partitionBy("component", F.date_trunc("day", "minute")).orderBy("minute")
    counter = minutes.select("component", F.unix_timestamp("minute").alias("seen_at"), F.sum("n").over(day).alias("total"))
    out = monitor.counter_increase(counter, ["component"], "total", "seen_at", F.floor(F.col("seen_at") / 21600))
    return out.withColumn("increase", F.col("increase").cast("double"))
