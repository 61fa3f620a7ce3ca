"""The transaction view over ``events`` and the fixed scoring used by checks.

Each view exists twice: as a DataFrame and as the SQL the checks run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywatch.operators.behavior import behavioral_features
from tallywatch.operators.features import base_features
from tallywatch.operators.route import DEFAULT_THRESHOLDS, assign_tiers, decide
from tallywatch.operators.validate import validate_transactions
from tallywatch.plans.registry import table

TYPE_OF_EVENT = {"purchase": "PAYMENT", "view": "CASH_IN", "click": "CASH_OUT", "signup": "DEBIT", "error": "TRANSFER"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_OF_EVENT.items()) + " END"


def _view(text: str, step: str, target: str) -> str:
    return f"""
SELECT concat('TXN-', CAST(event_id AS {text})) AS transaction_id, event_id, {step} AS step, ts,
  {_CASE} AS type,
  CASE WHEN event_id % 101 = 0 THEN -value ELSE value END AS amount,
  concat('C', CAST(user_id AS {text})) AS nameOrig,
  round(value * (event_id % 4), 2) AS oldbalanceOrg,
  CASE WHEN event_id % 7 = 0 THEN round(value * (event_id % 4), 2)
       ELSE greatest(round(value * (event_id % 4) - value, 2), 0.0) END AS newbalanceOrig,
  concat('M', {target}) AS nameDest,
  round(value * (event_id % 3), 2) AS oldbalanceDest,
  CASE WHEN event_id % 5 = 0 THEN round(value * (event_id % 3), 2)
       ELSE round(value * (event_id % 3) + value, 2) END AS newbalanceDest,
  CASE WHEN event_type IN ('error','click') AND event_id % 29 = 0 THEN 1 ELSE 0 END AS isFraud
FROM events"""


_SPARK_VIEW = _view(
    "STRING",
    "CAST(floor((unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000) / 3600000000) AS INT)",
    "get_json_object(props, '$.k')")
TX_SQL = _view(
    "VARCHAR", "CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000) AS INTEGER)",
    "json_extract_string(props, '$.k')")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", heavy=True)
    return spark.sql(_SPARK_VIEW.replace("FROM events", "FROM {events}"), events=events)


# Money carries two decimals, so a negative zero is the only trap: -0.0 is not < 0.
VALID_RULE = """step IS NOT NULL AND type IS NOT NULL AND amount IS NOT NULL AND nameOrig IS NOT NULL
  AND nameDest IS NOT NULL AND amount >= 0 AND oldbalanceOrg >= 0 AND newbalanceOrig >= 0
  AND oldbalanceDest >= 0 AND newbalanceDest >= 0"""
CTE_TX = f"tx AS ({TX_SQL}), valid AS (SELECT * FROM tx WHERE {VALID_RULE})"

_TYPES = ["CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"]
CTE_BASE = CTE_TX + """, base AS (
SELECT *, oldbalanceOrg - newbalanceOrig AS orig_balance_change,
  newbalanceDest - oldbalanceDest AS dest_balance_change,
  amount - (oldbalanceOrg - newbalanceOrig) AS orig_balance_error,
  amount - (newbalanceDest - oldbalanceDest) AS dest_balance_error,
  CASE WHEN newbalanceOrig = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS orig_zero_after,
  CASE WHEN oldbalanceDest = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS dest_zero_before,
  CASE WHEN newbalanceDest = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS dest_zero_after,
  ln(1 + amount) AS log_amount, """ + ", ".join(
    f"CASE WHEN type = '{t}' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"type_{t}\"" for t in _TYPES) + " FROM valid)"

# Brute force: every row against its own account's rows, independent of the cell method.
CTE_BEHAVIOR = CTE_BASE + """, pairs AS (
SELECT a.event_id, a.step - b.step AS d, b.amount AS b_amount, b.nameDest AS b_dest, b.type AS b_type,
  a.nameDest AS a_dest
FROM base a JOIN base b ON a.nameOrig = b.nameOrig AND b.step BETWEEN a.step - 24 AND a.step
  AND (b.step < a.step OR b.event_id < a.event_id)), agg AS (
SELECT event_id, count(*) FILTER (d <= 1) AS n1, count(*) FILTER (d <= 6) AS n6, count(*) AS n24,
  coalesce(sum(b_amount) FILTER (d <= 6), 0) AS a6, sum(b_amount) AS a24, min(d) AS gap,
  count(DISTINCT b_dest) AS dests, count(*) FILTER (b_type = 'CASH_OUT') AS co,
  count(*) FILTER (b_type = 'TRANSFER') AS tr, count(*) FILTER (b_dest = a_dest) AS seen
FROM pairs GROUP BY event_id), feat AS (
SELECT b.*, coalesce(n1, 0)::DOUBLE AS orig_tx_count_1step, coalesce(n6, 0)::DOUBLE AS orig_tx_count_6steps,
  coalesce(n24, 0)::DOUBLE AS orig_tx_count_24steps, coalesce(a6, 0)::DOUBLE AS orig_amount_sum_6steps,
  coalesce(a24, 0)::DOUBLE AS orig_amount_sum_24steps,
  (CASE WHEN coalesce(n6, 0) > 0 THEN a6 / n6 ELSE 0 END)::DOUBLE AS orig_avg_amount_6steps,
  (CASE WHEN coalesce(n24, 0) > 0 THEN a24 / n24 ELSE 0 END)::DOUBLE AS orig_avg_amount_24steps,
  (CASE WHEN coalesce(n24, 0) > 0 AND a24 > 0 THEN amount / (a24 / n24) ELSE 0 END)::DOUBLE
    AS orig_amount_ratio_to_avg_24steps,
  coalesce(gap, 0)::DOUBLE AS orig_time_since_prev_step,
  coalesce(dests, 0)::DOUBLE AS orig_unique_destinations_24steps,
  coalesce(co, 0)::DOUBLE AS orig_cashout_count_24steps, coalesce(tr, 0)::DOUBLE AS orig_transfer_count_24steps,
  (CASE WHEN coalesce(seen, 0) = 0 THEN 1 ELSE 0 END)::DOUBLE AS orig_new_destination,
  (CASE WHEN oldbalanceOrg > 0 THEN greatest(0, least(1, (oldbalanceOrg - newbalanceOrig) / oldbalanceOrg))
    ELSE 0 END)::DOUBLE AS orig_balance_depletion_ratio
FROM base b LEFT JOIN agg USING (event_id))"""

_SCORE = "round(0.03 * log_amount + 0.04 * orig_balance_depletion_ratio + 0.002 * orig_tx_count_6steps - 0.09, 6)"
_STAGE_TWO = "round(1 / (1 + exp(1.5 - 0.4 * log_amount - 0.3 * orig_new_destination)), 6)"
_T = DEFAULT_THRESHOLDS
CTE_DECIDED = CTE_BEHAVIOR + f""", scored AS (
SELECT *, {_SCORE} AS anomaly_score, {_STAGE_TWO} AS second_stage_probability FROM feat), tiered AS (
SELECT *, CASE WHEN anomaly_score < {_T['T1']!r} THEN 'L1' WHEN anomaly_score < {_T['T2']!r} THEN 'L2'
  WHEN anomaly_score < {_T['T3']!r} THEN 'L3' WHEN anomaly_score < {_T['T4']!r} THEN 'L4' ELSE 'L5' END
  AS risk_level FROM scored), flagged AS (
SELECT *, CASE WHEN risk_level IN ('L3','L4','L5') THEN 1 ELSE 0 END AS alert_required,
  CASE risk_level WHEN 'L1' THEN 'ALLOW_STORE' WHEN 'L2' THEN 'ALLOW_MONITOR_STORE' WHEN 'L3' THEN 'INVESTIGATE'
    WHEN 'L4' THEN 'PRIORITY_INVESTIGATE' ELSE 'CRITICAL_INVESTIGATE' END AS risk_action,
  CASE WHEN risk_level IN ('L1','L2') THEN second_stage_probability END AS xgboost_probability,
  CASE WHEN risk_level IN ('L1','L2') THEN (second_stage_probability >= 0.5)::INT END AS xgboost_prediction
FROM tiered), decided AS (
SELECT *, CASE WHEN alert_required = 1 THEN 1 ELSE xgboost_prediction END AS final_prediction,
  CASE WHEN alert_required = 1 THEN 'Isolation Forest -> fraud-alerts'
    WHEN xgboost_prediction = 1 THEN 'L1/L2 -> XGBoost -> fraud-alerts'
    ELSE 'L1/L2 -> XGBoost -> low-risk' END AS final_decision_path,
  CASE WHEN alert_required = 1 THEN risk_action WHEN xgboost_prediction = 1 THEN 'FRAUD_ALERT'
    ELSE 'LOW_RISK_STORE' END AS final_risk_action FROM flagged)"""


def valid_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate_transactions(transactions(spark, sf_dir))


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavioral_features(base_features(valid_transactions(spark, sf_dir)))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features plus a fixed score and a fixed second-stage probability."""
    return featured(spark, sf_dir).withColumns({
        "anomaly_score": F.expr(_SCORE), "second_stage_probability": F.expr(_STAGE_TWO)})


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(assign_tiers(scored(spark, sf_dir)))
