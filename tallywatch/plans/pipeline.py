"""Queries: validation, features, tiers, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywatch.functions.ids import alert_id
from tallywatch.operators import behavior, features, route, validate
from tallywatch.plans import inputs
from tallywatch.plans.inputs import CTE_BASE, CTE_BEHAVIOR, CTE_DECIDED, CTE_TX
from tallywatch.plans.registry import query, table
from tallywatch.schema import BASE_FEATURES, BEHAVIOR_FEATURES, MODEL_FEATURES, require_feature_contract


# Cents over a power of two end exactly half way between two rounded values, where the last
# bit of a sum decides. A shift far below the shown digits takes such values off the edge.
_OFF_EDGE = 3.3e-08


def _rounded(names: list[str], digits: int = 6) -> list:
    # Adding 0.0 turns a rounded negative zero into zero.
    return [(F.round(F.col(n).cast("double") + F.lit(_OFF_EDGE), digits) + F.lit(0.0)).alias(n) for n in names]


def _rounded_sql(names: list[str], digits: int = 6) -> str:
    return ", ".join(f'round("{n}"::DOUBLE + {_OFF_EDGE!r}, {digits}) + 0.0 AS "{n}"' for n in names)


@query("validated_transactions", f"WITH {CTE_TX} SELECT * EXCLUDE (ts) FROM valid")
def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.valid_transactions(spark, sf_dir).drop("ts")


@query("rejected_transactions", f"""WITH {CTE_TX}
SELECT violation, count(*) AS n FROM (
  SELECT unnest(list_filter([
    CASE WHEN type IS NULL THEN 'missing:type' END, CASE WHEN amount IS NULL THEN 'missing:amount' END,
    CASE WHEN amount < 0 THEN 'negative:amount' END, CASE WHEN oldbalanceOrg < 0 THEN 'negative:oldbalanceOrg' END,
    CASE WHEN newbalanceOrig < 0 THEN 'negative:newbalanceOrig' END,
    CASE WHEN oldbalanceDest < 0 THEN 'negative:oldbalanceDest' END,
    CASE WHEN newbalanceDest < 0 THEN 'negative:newbalanceDest' END], lambda x: x IS NOT NULL)) AS violation FROM tx)
GROUP BY violation""")
def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = validate.split_rejects(inputs.transactions(spark, sf_dir), validate.transaction_rules())
    return bad.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


@query("manual_event_bounds", f"""WITH {CTE_TX}
SELECT event_id, array_to_string(list_filter([
  CASE WHEN step < 0 OR step > 2147483647 THEN 'range:step' END,
  CASE WHEN amount < 0 OR amount > 1e15 THEN 'range:amount' END,
  CASE WHEN length(nameOrig) > 128 THEN 'length:nameOrig' END,
  CASE WHEN length(nameDest) > 128 THEN 'length:nameDest' END], lambda x: x IS NOT NULL), ',') AS violations
FROM tx WHERE amount < 0 OR amount > 1e15 OR step < 0""")
def manual_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [c for c in inputs.transactions(spark, sf_dir).columns if c in validate.MANUAL_EVENT_FIELDS]
    _, bad = validate.split_rejects(inputs.transactions(spark, sf_dir), validate.manual_event_rules(columns))
    return bad.select("event_id", F.concat_ws(",", "violations").alias("violations"))


@query("base_features", f"WITH {CTE_BASE} SELECT event_id, {_rounded_sql(BASE_FEATURES)} FROM base")
def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.base_features(inputs.valid_transactions(spark, sf_dir))
    return df.select("event_id", *_rounded(BASE_FEATURES))


@query("clipped_log_and_discovered_types", f"""WITH {CTE_TX}
SELECT event_id, round(ln(1 + greatest(amount, 0)), 6) AS log_amount,
  {', '.join(f"CASE WHEN type = '{t}' THEN 1.0 ELSE 0.0 END::DOUBLE AS kind_{t}"
             for t in ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"))} FROM tx""")
def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = inputs.transactions(spark, sf_dir)
    kinds = features.discovered_categories(df, "type")
    out = features.one_hot(features.log_amount(df, clip=True), "type", kinds, "kind")
    return out.select("event_id", F.round("log_amount", 6).alias("log_amount"), *[f"kind_{k}" for k in kinds])


@query("finite_report", f"""WITH {CTE_BASE} """ + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (\"{c}\" IS NULL) AS null_count, "
    f"count(*) FILTER (isnan(\"{c}\"::DOUBLE)) AS nan_count, count(*) FILTER (isinf(\"{c}\"::DOUBLE)) AS inf_count "
    f"FROM base" for c in BASE_FEATURES))
def finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.finite_report(features.base_features(inputs.valid_transactions(spark, sf_dir)), BASE_FEATURES)


@query("behavioral_features", f"WITH {CTE_BEHAVIOR} SELECT event_id, {_rounded_sql(BEHAVIOR_FEATURES)} FROM feat")
def behavioral(spark: SparkSession, sf_dir: str) -> DataFrame:
    require_feature_contract([c for c in MODEL_FEATURES])
    return inputs.featured(spark, sf_dir).select("event_id", *_rounded(BEHAVIOR_FEATURES))


@query("true_gap_feature", f"""WITH {CTE_TX}
SELECT event_id, coalesce(step - lag(step) OVER (PARTITION BY nameOrig ORDER BY step, event_id), 0)::DOUBLE
  AS orig_time_since_prev_step FROM valid""")
def true_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = behavior.behavioral_features(inputs.valid_transactions(spark, sf_dir), gap_mode="last")
    return df.select("event_id", "orig_time_since_prev_step")


@query("order_history_features", """WITH o AS (
SELECT o_orderkey AS id, o_custkey AS k, o_totalprice AS amount, o_orderpriority AS p,
  CAST(floor(epoch_us(o_orderdate) / 86400000000) AS INTEGER) AS step FROM orders), p AS (
SELECT a.id, count(b.id) AS n, count(b.id) FILTER (a.step - b.step <= 6) AS n6, coalesce(sum(b.amount), 0) AS s,
  count(DISTINCT b.p) AS d, max(CASE WHEN b.p = a.p THEN 1 ELSE 0 END) AS seen
FROM o a LEFT JOIN o b ON a.k = b.k AND b.step BETWEEN a.step - 24 AND a.step
  AND (b.step < a.step OR b.id < a.id) GROUP BY a.id)
SELECT id, n6::DOUBLE AS orig_tx_count_6steps, n::DOUBLE AS orig_tx_count_24steps,
  round(s, 4) + 0.0 AS orig_amount_sum_24steps, d::DOUBLE AS orig_unique_destinations_24steps,
  (1 - seen)::DOUBLE AS orig_new_destination FROM p""")
def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.expr("CAST(floor(unix_micros(CAST(o_orderdate AS TIMESTAMP)) / 86400000000) AS INT)")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("p"), day.alias("step"),
        F.lit(0.0).alias("oldbalanceOrg"), F.lit(0.0).alias("newbalanceOrig"))
    out = behavior.behavioral_features(rows, key="k", order="id", destination="p", kind="p")
    return out.select("id", "orig_tx_count_6steps", "orig_tx_count_24steps",
                      F.round("orig_amount_sum_24steps", 4).alias("orig_amount_sum_24steps"),
                      "orig_unique_destinations_24steps", "orig_new_destination")


@query("retained_account_history", f"""WITH {CTE_TX}
SELECT event_id, nameOrig, step FROM valid
QUALIFY step >= max(step) OVER (PARTITION BY nameOrig) - 24""")
def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.account_history(inputs.valid_transactions(spark, sf_dir)).select("event_id", "nameOrig", "step")


@query("whole_account_features", f"""WITH {CTE_TX}, a AS (
SELECT nameOrig, count(*) AS n, sum(amount) AS s, count(DISTINCT nameDest) AS d,
  count(*) FILTER (type = 'CASH_OUT') AS c, count(*) FILTER (type = 'TRANSFER') AS t FROM valid GROUP BY nameOrig)
SELECT event_id, n::DOUBLE AS orig_tx_count_24steps, round(s, 4) AS orig_amount_sum_24steps,
  round(s / n + {_OFF_EDGE!r}, 6) + 0.0 AS orig_avg_amount_24steps,
  round(amount / (s / n + 1e-6) + {_OFF_EDGE!r}, 6) + 0.0 AS orig_amount_ratio_to_avg_24steps,
  coalesce(step - lag(step) OVER (PARTITION BY nameOrig ORDER BY step, event_id), 0)::DOUBLE
    AS orig_time_since_prev_step,
  d::DOUBLE AS orig_unique_destinations_24steps, c::DOUBLE AS orig_cashout_count_24steps,
  t::DOUBLE AS orig_transfer_count_24steps, (d = 1)::INT::DOUBLE AS orig_new_destination,
  round(greatest(0, least(1, (oldbalanceOrg - newbalanceOrig) / (oldbalanceOrg + 1e-6))) + {_OFF_EDGE!r}, 6) + 0.0
    AS orig_balance_depletion_ratio
FROM valid JOIN a USING (nameOrig)""")
def whole_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = behavior.whole_account_features(inputs.valid_transactions(spark, sf_dir))
    return out.select("event_id", "orig_tx_count_24steps",
                      F.round("orig_amount_sum_24steps", 4).alias("orig_amount_sum_24steps"),
                      *_rounded(["orig_avg_amount_24steps", "orig_amount_ratio_to_avg_24steps"]),
                      "orig_time_since_prev_step", "orig_unique_destinations_24steps",
                      "orig_cashout_count_24steps", "orig_transfer_count_24steps", "orig_new_destination",
                      *_rounded(["orig_balance_depletion_ratio"]))


@query("risk_tiers", f"""WITH {CTE_DECIDED}
SELECT event_id, anomaly_score, risk_level, alert_required, risk_action FROM decided""")
def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.assign_tiers(inputs.scored(spark, sf_dir)).select(
        "event_id", "anomaly_score", "risk_level", "alert_required", "risk_action")


@query("final_decisions", f"""WITH {CTE_DECIDED}
SELECT transaction_id, risk_level, xgboost_probability, xgboost_prediction::DOUBLE AS xgboost_prediction,
  final_prediction, final_decision_path, final_risk_action FROM decided""")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.decided(spark, sf_dir).select(
        "transaction_id", "risk_level", "xgboost_probability", F.col("xgboost_prediction").cast("double"),
        "final_prediction", "final_decision_path", "final_risk_action")


@query("routed_decision_counts", f"""WITH {CTE_DECIDED}
SELECT CASE WHEN final_prediction = 1 THEN 'fraud-alerts' ELSE 'low-risk' END AS route, risk_level,
  final_decision_path, final_risk_action, count(*) AS n, round(sum(amount), 2) AS amount
FROM decided GROUP BY ALL""")
def routed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (route.routed(inputs.decided(spark, sf_dir))
            .groupBy("route", "risk_level", "final_decision_path", "final_risk_action")
            .agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount")))


@query("decision_counters", f"""WITH {CTE_DECIDED}
SELECT count(*) AS total, count(*) FILTER (alert_required = 0) AS second_stage_input,
  count(*) FILTER (alert_required = 1) AS direct_alerts,
  count(*) FILTER (xgboost_prediction = 1) AS second_stage_alerts,
  count(*) FILTER (xgboost_prediction = 0) AS low_risk FROM decided""")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.decision_counts(inputs.decided(spark, sf_dir))


_UUID5 = """lower(concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-',
  substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1), substr(h, 18, 3), '-',
  substr(h, 21, 12)))"""
UUID5_HASH = "sha1('\\x6B\\xA7\\xB8\\x11\\x9D\\xAD\\x11\\xD1\\x80\\xB4\\x00\\xC0\\x4F\\xD4\\x30\\xC8'::BLOB || encode('fraud-alert:' || transaction_id))"


@query("alert_ids", f"""WITH {CTE_TX}, hashed AS (SELECT transaction_id, {UUID5_HASH} AS h FROM tx)
SELECT transaction_id, {_UUID5} AS alert_id FROM hashed""")
def alert_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = inputs.transactions(spark, sf_dir)
    return df.select("transaction_id", alert_id(None, F.col("transaction_id")).alias("alert_id"))


@query("normalized_alerts", f"""WITH {CTE_TX}, hashed AS (SELECT *, {UUID5_HASH} AS h FROM tx)
SELECT {_UUID5} AS alert_id, transaction_id, type AS transaction_type, nameOrig AS name_orig, nameDest AS name_dest,
  oldbalanceOrg AS old_balance_orig, newbalanceOrig AS new_balance_orig, oldbalanceDest AS old_balance_dest,
  newbalanceDest AS new_balance_dest, strftime(ts, '%Y-%m-%d') AS event_date, hour(ts)::INT AS event_hour
FROM hashed""")
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = inputs.transactions(spark, sf_dir).withColumn(
        "event_time", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    out = validate.normalize_alerts(stamped)
    return out.select("alert_id", "transaction_id", "transaction_type", "name_orig", "name_dest", "old_balance_orig",
                      "new_balance_orig", "old_balance_dest", "new_balance_dest", "event_date", "event_hour")


_ROW = """SELECT nameOrig AS name_orig, transaction_id, strftime(ts, '%Y-%m-%d') AS event_date,
  hour(ts)::INT AS event_hour, type AS transaction_type, nameDest AS name_dest, amount, anomaly_score, risk_level,
  xgboost_probability, xgboost_prediction::DOUBLE AS xgboost_prediction, final_prediction = 1 AS final_prediction"""


def _payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.decided(spark, sf_dir).withColumns({
        "event_time": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "source": F.lit("paysim")})


@query("transaction_table_rows", f"WITH {CTE_DECIDED} {_ROW} FROM decided WHERE final_prediction = 0")
def transaction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = validate.transaction_rows(_payload(spark, sf_dir).where("final_prediction = 0"))
    return good.select(
        "name_orig", "transaction_id", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), "event_hour",
        "transaction_type", "name_dest", "amount", "anomaly_score", "risk_level", "xgboost_probability",
        F.col("xgboost_prediction").cast("double"), "final_prediction")


@query("alert_table_rows", f"""WITH {CTE_DECIDED}, hashed AS (SELECT *, {UUID5_HASH} AS h FROM decided)
{_ROW}, {_UUID5} AS alert_id, alert_required = 1 AS alert_required, final_risk_action, 'NEW' AS status
FROM hashed WHERE final_prediction = 1""")
def alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = validate.alert_rows(_payload(spark, sf_dir).where("final_prediction = 1"))
    return good.select(
        "name_orig", "transaction_id", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), "event_hour",
        "transaction_type", "name_dest", "amount", "anomaly_score", "risk_level", "xgboost_probability",
        F.col("xgboost_prediction").cast("double"), "final_prediction", "alert_id", "alert_required", "final_risk_action", "status")


@query("rejected_payloads", f"""WITH {CTE_DECIDED}
SELECT violation, count(*) AS n FROM (SELECT unnest(list_filter([
  CASE WHEN xgboost_probability IS NULL THEN 'missing:source' END, CASE WHEN nameDest = 'M7' THEN 'missing:nameDest' END,
  CASE WHEN event_id % 40 = 1 THEN 'invalid:event_time' END], lambda x: x IS NOT NULL)) AS violation FROM decided) GROUP BY 1""")
def rejected_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with planted holes; every broken rule is named."""
    holes = _payload(spark, sf_dir).withColumns({
        "source": F.when(F.col("xgboost_probability").isNotNull(), F.col("source")),
        "nameDest": F.when(F.col("nameDest") == "M7", "").otherwise(F.col("nameDest")),
        "event_time": F.when(F.col("event_id") % 40 == 1, "soon").otherwise(F.col("event_time"))})
    _, bad = validate.transaction_rows(holes)
    return bad.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


@query("event_time_parsing", """SELECT event_id, epoch_us(ts) AS utc_micros FROM events""")
def event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywatch.functions.times import parse_event_time

    # The same instant written with an offset must come back as the same UTC time.
    shifted = F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'")
    parsed = table(spark, sf_dir, "events").select("event_id", parse_event_time(shifted).alias("at"))
    return parsed.select("event_id", F.unix_micros("at").alias("utc_micros"))


@query("imputed_columns", """WITH t AS (
SELECT event_id, CASE WHEN event_id % 10 = 3 THEN NULL ELSE value END AS value,
  CASE WHEN event_id % 13 = 5 THEN NULL ELSE event_type END AS kind FROM events),
m AS (SELECT quantile_cont(value, 0.5) AS med FROM t)
SELECT event_id, round(coalesce(value, med), 6) AS value, coalesce(kind, 'Unknown') AS kind FROM t, m""")
def imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 10 != 3, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 13 != 5, F.col("event_type")).alias("kind"))
    out = validate.impute(holes, ["value"], ["kind"])
    return out.select("event_id", F.round("value", 6).alias("value"), "kind")


@query("searched_transactions", f"""WITH {CTE_DECIDED}
SELECT transaction_id, risk_level, amount FROM decided
WHERE (transaction_id ILIKE '%c1%' OR nameOrig ILIKE '%c1%' OR nameDest ILIKE '%c1%')
  AND type = 'CASH_OUT' AND amount >= 5 AND amount <= 60""")
def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = validate.search_predicate(search="c1", transaction_type="CASH_OUT", amount_min=5, amount_max=60)
    return inputs.decided(spark, sf_dir).where(rule).select("transaction_id", "risk_level", "amount")


@query("redacted_fields", """SELECT event_id, event_type AS kind, value AS nested_value,
  value * 2 AS nested_list_value FROM events""")
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("kind"), F.col("props").alias("Api_Token"),
        F.struct(F.col("value"), F.col("props").alias("password")).alias("inner"),
        F.array(F.struct((F.col("value") * 2).alias("twice"), F.lit("x").alias("private_key_pem"))).alias("items"))
    clean = validate.drop_sensitive(nested)
    if any(validate.is_sensitive(name) for name in clean.columns):
        raise AssertionError("a sensitive column survived")
    return clean.select("event_id", "kind", F.col("inner.*"), F.inline("items")).withColumnsRenamed(
        {"value": "nested_value", "twice": "nested_list_value"})
