"""Control-plane reporting over the batch, transaction and activity tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywatch.functions.ids import alert_id
from tallywatch.operators.evaluate import ratio
from tallywatch.operators.ordered import leading_rows, position_in_group
from tallywatch.schema import RISK_TIERS

# Statuses.
PROCESSED = ["FRAUD_ALERT", "LOW_RISK"]
PARTLY_DONE = ["PARTIAL", "INSUFFICIENT_EVIDENCE"]
DONE = ["COMPLETED", *PARTLY_DONE]
SORT_COLUMNS = {"generated_at": "generated_at", "amount": "amount", "type": "type", "risk_level": "risk_level"}
ACTIVITY_KEPT = 10_000


def _investigated(*statuses: str) -> Column:
    return F.col("investigation_status").isin(list(statuses))


def batch_counts(transactions: DataFrame) -> DataFrame:
    """Progress counters of every batch in one aggregation."""
    status, has_alert = F.col("processing_status"), F.col("alert_id").isNotNull()
    return transactions.groupBy("batch_id").agg(
        F.count_if(status.isin(PROCESSED)).alias("processed"),
        F.count_if(status == "FRAUD_ALERT").alias("fraud_alerts"),
        F.count_if(status == "LOW_RISK").alias("low_risk"),
        F.count_if(has_alert).alias("investigation_requests"),
        F.count_if(_investigated(*DONE)).alias("investigations_completed"),
        F.count_if(_investigated("COMPLETED")).alias("investigations_succeeded"),
        F.count_if(_investigated(*PARTLY_DONE)).alias("investigations_partial"),
        F.count_if(_investigated("PENDING") & has_alert).alias("investigations_pending"),
        F.count_if(_investigated("FAILED")).alias("investigations_failed"))


def global_summary(batches: DataFrame, transactions: DataFrame) -> DataFrame:
    """Four batch sums and seven counts of processed transactions, as one row."""
    sums = batches.agg(*[F.sum(f"{n}_count").alias(n) for n in ("requested", "generated", "sent", "failed")])
    status, has_alert = F.col("processing_status"), F.col("alert_id").isNotNull()
    counts = transactions.where(status.isin(PROCESSED)).agg(
        F.count("*").alias("processed"),
        F.count_if(status == "FRAUD_ALERT").alias("fraud_alerts"),
        F.count_if(status == "LOW_RISK").alias("low_risk"),
        F.count_if(has_alert).alias("investigations"),
        F.count_if(_investigated("PENDING") & has_alert).alias("investigation_pending"),
        F.count_if(_investigated(*DONE)).alias("investigation_success"),
        F.count_if(_investigated("FAILED")).alias("investigation_failed"))
    both = sums.unionByName(counts, allowMissingColumns=True)
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in both.columns])


def ledger_page(df: DataFrame, predicate: Column | None = None, page: int = 1, page_size: int = 25,
                sort_by: str = "generated_at", descending: bool = True) -> tuple[DataFrame, int]:
    """(rows of one page, total matching rows). Ties keep the sequence order."""
    matching = df if predicate is None else df.where(predicate)
    column = F.col(SORT_COLUMNS.get(sort_by, "generated_at"))
    ordered = matching.orderBy(column.desc() if descending else column.asc(), F.col("sequence_number").asc(),
                               F.col("transaction_id").asc())
    return ordered.offset((page - 1) * page_size).limit(page_size), matching.count()


def progress_pct(generated: Column, requested: Column) -> Column:
    return F.when(requested > 0, F.least(F.lit(100.0), F.round(100 * generated / requested, 1))).otherwise(0.0)


def final_batch_status(cancelled: Column) -> Column:
    sent, asked, failed = F.col("sent_count"), F.col("requested_count"), F.col("failed_count")
    return (F.when(cancelled, "CANCELLED").when((sent == asked) & (failed == 0), "COMPLETED")
            .when(sent > 0, "PARTIAL").otherwise("FAILED"))


def recent(df: DataFrame, order: str | Sequence[str], limit: int) -> DataFrame:
    keys = [order] if isinstance(order, str) else list(order)
    return df.orderBy(*[F.col(k).desc() for k in keys]).limit(limit)


def bounded_log(log: DataFrame, order: str = "event_id", keep: int = ACTIVITY_KEPT) -> DataFrame:
    """The newest rows of an activity log; older ones are dropped by design."""
    return leading_rows(log, order, keep, descending=True)


DECISION_FIELDS = ["risk_level", "anomaly_score", "xgboost_probability", "xgboost_prediction", "final_prediction"]


def merge_decisions(transactions: DataFrame, decisions: DataFrame, order: str = "offset") -> DataFrame:
    """Apply the newest decision per transaction; decisions for unknown ids are ignored.

    ``decisions`` carries ``topic`` ('fraud' or other), the payload fields and an
    order column. Pre-aggregation leaves one decision per id before the join.
    """
    alert = F.col("topic") == "fraud"
    supplied = F.col("alert_id") if "alert_id" in decisions.columns else None
    shaped = decisions.select(
        "transaction_id", order,
        F.struct(
            F.when(alert, "FRAUD_ALERT").otherwise("LOW_RISK").alias("processing_status"),
            *[F.col(c) for c in DECISION_FIELDS],
            F.col("final_decision_path").alias("decision_path"),
            F.coalesce(F.nullif(F.col("final_risk_action"), F.lit("")),
                       F.when(alert, "FRAUD_ALERT").otherwise("LOW_RISK")).alias("final_decision"),
            F.when(alert, alert_id(supplied, F.col("transaction_id"))).alias("alert_id"),
            F.when(alert, "PENDING").otherwise("NOT_APPLICABLE").alias("investigation_status"),
        ).alias("decision"))
    newest = shaped.groupBy("transaction_id").agg(F.max_by("decision", F.col(order)).alias("decision"))
    fields = ["processing_status", *DECISION_FIELDS, "decision_path", "final_decision", "alert_id",
              "investigation_status"]
    joined = transactions.join(newest, "transaction_id", "left")
    present = set(transactions.columns)
    decided = F.col("decision").isNotNull()
    return joined.withColumns({
        name: F.when(decided, F.col("decision")[name]).otherwise(F.col(name) if name in present else F.lit(None))
        for name in fields
    }).drop("decision")


def batch_requests(requests: DataFrame) -> DataFrame:
    """Outcome per request: created, existing (same key and body) or conflict.

    Needs idempotency_key, request_hash, requested_at and a unique request_id.
    Requests without a key always create a batch.
    """
    first = requests.where(F.col("idempotency_key").isNotNull()).groupBy("idempotency_key").agg(
        F.min_by(F.struct("request_id", "request_hash"), F.struct("requested_at", "request_id")).alias("first"))
    joined = requests.join(first, "idempotency_key", "left")
    same = F.col("request_hash") == F.col("first.request_hash")
    return joined.withColumns({
        "outcome": F.when(F.col("first").isNull() | (F.col("request_id") == F.col("first.request_id")), "created")
        .when(same, "existing").otherwise("conflict"),
        "effective_request_id": F.coalesce(F.col("first.request_id"), F.col("request_id")),
    }).drop("first")


def conflicting_keys(requests: DataFrame) -> DataFrame:
    """Idempotency keys used for more than one body."""
    return requests.where(F.col("idempotency_key").isNotNull()).groupBy("idempotency_key").agg(
        F.count("*").alias("requests"), F.count_distinct("request_hash").alias("bodies")).where("bodies > 1")


def dashboard(batches: DataFrame, transactions: DataFrame, activity: DataFrame) -> DataFrame:
    """One row: summary, five batches, eight transactions, twelve activity entries."""

    def listed(df: DataFrame, order: list[str], limit: int, fields: list[str], name: str) -> DataFrame:
        top = recent(df, order, limit).select(F.struct(*order, *fields).alias("item"))
        return top.agg(F.sort_array(F.collect_list("item"), asc=False).alias(name))

    summary = global_summary(batches, transactions)
    parts = [
        summary.select(F.struct(*summary.columns).alias("summary")),
        listed(batches, ["created_at", "batch_id"], 5, ["status", "progress"], "recent_batches"),
        listed(transactions, ["generated_at", "transaction_id"], 8, ["risk_level", "processing_status"],
               "recent_transactions"),
        listed(activity, ["event_id"], 12, ["event_type", "batch_id"], "recent_activity"),
    ]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    return both.agg(*[F.any_value(c, ignoreNulls=F.lit(True)).alias(c) for c in both.columns])


def ground_truth_report(df: DataFrame) -> DataFrame:
    """Decision quality over the whole ledger: predicted by flag or by status."""
    truth = F.col("isFraud") == 1
    said = F.coalesce(F.col("final_prediction") == 1, F.lit(False)) | (F.col("processing_status") == "FRAUD_ALERT")
    processed = F.col("processing_status").isin(PROCESSED)
    row = df.agg(
        F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"),
        F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn"),
        F.count_if(processed).alias("processed"), F.count("*").alias("rows"),
        F.count_if(F.col("processing_status") == "FRAUD_ALERT").alias("alerts"),
        *[F.count_if(F.col("risk_level") == t).alias(f"{t}_rows") for t in RISK_TIERS])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return row.withColumns({
        "precision_pct": ratio(tp * 100.0, tp + fp), "recall_pct": ratio(tp * 100.0, tp + fn),
        "f1_pct": ratio(tp * 200.0, 2 * tp + fp + fn), "alert_rate_pct": ratio(F.col("alerts") * 100.0, F.col("processed")),
        **{f"{t}_pct": ratio(F.col(f"{t}_rows") * 100.0, F.col("rows")) for t in RISK_TIERS}})


def message_sequence(messages: DataFrame, conversation: str, order: str) -> DataFrame:
    """1-based number of each message in its conversation, however long that is."""
    return position_in_group(messages, [conversation], order, "sequence_number")


def not_yet_investigated(alerts: DataFrame, results: DataFrame) -> DataFrame:
    return alerts.join(results.select("alert_id"), "alert_id", "left_anti")


def newest_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Last write per key, reduced before the shuffle."""
    fields = [c for c in df.columns if c != key]
    newest = df.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_row"))
    return newest.select(key, "_row.*")


def update_pending(transactions: DataFrame, results: DataFrame) -> DataFrame:
    """Give pending alerts the status of their newest result, if there is one."""
    newest = newest_per_key(results, "alert_id", ["generated_at", "investigation_id"]).select(
        "alert_id", F.struct(
            F.upper(F.coalesce(F.col("investigation_status"), F.lit("failed"))).alias("status"),
            F.col("investigation_id")).alias("_result"))
    pending = (F.col("investigation_status") == "PENDING") & F.col("alert_id").isNotNull()
    hit = pending & F.col("_result").isNotNull()
    known_id = F.col("investigation_id") if "investigation_id" in transactions.columns else F.lit(None).cast("string")
    return transactions.join(newest, "alert_id", "left").withColumns({
        "investigation_status": F.when(hit, F.col("_result.status")).otherwise(F.col("investigation_status")),
        "investigation_id": F.when(hit, F.col("_result.investigation_id")).otherwise(known_id),
    }).drop("_result")


def latest_messages(df: DataFrame, conversation: str, order: str, text: str, turns: int = 10, chars: int = 800) -> DataFrame:
    """The last turns of each conversation with clipped text.

    The rank filter is applied before the shuffle, so a long conversation sends
    ten rows per task, not all of them.
    """
    newest = Window.partitionBy(conversation).orderBy(F.col(order).desc())
    return (df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= turns)
            .withColumn(text, F.substring(text, 1, chars)).drop("_rank"))
