"""Queries: evaluation, calibration, splits, profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywatch.operators import evaluate, profile, splits
from tallywatch.operators.route import assign_tiers
from tallywatch.plans import inputs
from tallywatch.plans.inputs import CTE_BASE, CTE_DECIDED, CTE_TX
from tallywatch.plans.registry import query, table
from tallywatch.schema import BEHAVIOR_FEATURES

CTE_JUDGED = """judged AS (SELECT d.doc_id, d.n_chars::DOUBLE AS score, l.toxic AS label, l.quality, d.lang, d.source
FROM documents d JOIN labels l USING (doc_id))"""
RATES = ("precision", "recall", "f1", "fpr", "fnr", "accuracy")
RATES_SQL = """coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1, coalesce(fp / nullif(fp + tn, 0), 0)::DOUBLE AS fpr,
  coalesce(fn / nullif(tp + fn, 0), 0)::DOUBLE AS fnr,
  coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0)::DOUBLE AS accuracy"""
LENGTH_GRID = [0.0, 50.0, 100.0, 200.0, 400.0, 600.0, 800.0, 1200.0, 2000.0, 4000.0, 8000.0, 1e9]


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score and a label per labelled document: length against the toxic flag."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"),
                                                    "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"), "quality")
    return docs.join(labels, "doc_id")


def _round(df: DataFrame, columns, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns})


def _round_sql(columns, digits: int = 8) -> str:
    return ", ".join(f"round({c}::DOUBLE, {digits}) + 0.0 AS {c}" for c in columns)


@query("tier_thresholds", f"""WITH {CTE_JUDGED}
SELECT round(quantile_cont(score, 0.99), 6) AS "T1", round(quantile_cont(score, 0.995), 6) AS "T2",
  round(quantile_cont(score, 0.999), 6) AS "T3", round(quantile_cont(score, 0.9995), 6) AS "T4"
FROM judged WHERE label = 0""")
def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.tier_thresholds(judged(spark, sf_dir), "score", "label")
    return spark.createDataFrame([tuple(round(v, 6) for v in found.values())],
                                 ", ".join(f"{name} double" for name in found))


@query("population_report", f"""WITH {CTE_DECIDED}, s AS (
SELECT *, row_number() OVER (ORDER BY step, amount, event_id) - 1 AS r, count(*) OVER () AS n FROM decided), t AS (
SELECT *, CASE WHEN r < floor(0.6 * n) THEN 'train' WHEN r < floor(0.8 * n) THEN 'validation' ELSE 'test' END AS split
FROM s)
SELECT split, count(*) AS total_rows, count(*) FILTER (isFraud = 1) AS fraud_rows,
  count(*) FILTER (isFraud = 0) AS legitimate_rows,
  {', '.join(f"count(*) FILTER (risk_level = 'L{i}') AS L{i}_rows" for i in range(1, 6))},
  {', '.join(f"count(*) FILTER (risk_level = 'L{i}' AND isFraud = 1) AS fraud_in_L{i}" for i in range(1, 6))}
FROM t GROUP BY split""")
def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = splits.chronological_label(inputs.valid_transactions(spark, sf_dir))
    return evaluate.population_report(assign_tiers(inputs.scored(spark, sf_dir)).withColumn("split", split))


@query("split_fraud_guard", f"""WITH {CTE_DECIDED}, s AS (
SELECT *, row_number() OVER (ORDER BY step, amount, event_id) - 1 AS r, count(*) OVER () AS n FROM decided)
SELECT CASE WHEN r < floor(0.6 * n) THEN 'train' WHEN r < floor(0.8 * n) THEN 'validation' ELSE 'test' END AS split,
  max(isFraud) = 1 AS has_fraud, max(CASE WHEN risk_level IN ('L1', 'L2') THEN isFraud ELSE 0 END) = 1 AS has_low_tier_fraud
FROM s GROUP BY 1""")
def fraud_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.fraud_guard(population(spark, sf_dir))


@query("confusion_metrics", f"""WITH {CTE_JUDGED}, c AS (
SELECT lang, count(*) FILTER (label = 1 AND score >= 600) AS tp, count(*) FILTER (label = 0 AND score >= 600) AS fp,
  count(*) FILTER (label = 1 AND score < 600) AS fn, count(*) FILTER (label = 0 AND score < 600) AS tn
FROM judged GROUP BY lang) SELECT lang, tp, fp, fn, tn, {RATES_SQL} FROM c""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = judged(spark, sf_dir).withColumn("said", (F.col("score") >= 600).cast("int"))
    return evaluate.confusion(df, "label", "said", ["lang"])


@query("normalized_confusion", f"""WITH {CTE_JUDGED}
SELECT label, said, n, round(n / sum(n) OVER (PARTITION BY label), 8)::DOUBLE AS share FROM (
SELECT label, (score >= 600)::INT AS said, count(*) AS n FROM judged GROUP BY 1, 2)""")
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = judged(spark, sf_dir).withColumn("said", (F.col("score") >= 600).cast("int"))
    return _round(evaluate.normalized_confusion(df, "label", "said"), ["share"])


@query("classification_report", f"""WITH {CTE_JUDGED}, p AS (SELECT label, (score >= 600)::INT AS said FROM judged),
k AS (SELECT 0 AS c UNION ALL SELECT 1), per AS (
SELECT c, (SELECT count(*) FROM p WHERE label = c) AS support, (SELECT count(*) FROM p WHERE said = c) AS said,
  (SELECT count(*) FROM p WHERE said = c AND label = c) AS hit FROM k), m AS (
SELECT c::VARCHAR AS class, coalesce(hit / nullif(said, 0), 0) AS precision,
  coalesce(hit / nullif(support, 0), 0) AS recall, coalesce(2 * hit / nullif(said + support, 0), 0) AS f1, support
FROM per), a AS (SELECT * FROM m
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM m
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), sum(support)::BIGINT FROM m)
SELECT class, {_round_sql(('precision', 'recall', 'f1'))}, support FROM a""")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = judged(spark, sf_dir).withColumn("said", (F.col("score") >= 600).cast("int"))
    return _round(evaluate.classification_report(df, "label", "said"), ["precision", "recall", "f1"])


def _sweep_sql(values: str) -> str:
    """The naive form: every threshold against every row."""
    return f"""cand AS ({values}), sweep AS (
SELECT ordinal, threshold, count(*) FILTER (label = 1 AND score >= threshold) AS tp,
  count(*) FILTER (label = 0 AND score >= threshold) AS fp, count(*) FILTER (label = 1 AND score < threshold) AS fn,
  count(*) FILTER (label = 0 AND score < threshold) AS tn FROM cand, judged GROUP BY ordinal, threshold),
rates AS (SELECT ordinal, threshold, tp, fp, fn, tn, tp + fp AS alerts, (tp + fp) / (tp + fp + fn + tn) AS alert_rate,
  {RATES_SQL} FROM sweep)"""


_GRID_VALUES = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(LENGTH_GRID)) + ") v(ordinal, threshold)"
_SPACED_VALUES = """SELECT i::INT AS ordinal, lo + i * ((hi - lo) / 39) AS threshold
FROM (SELECT quantile_cont(score, 0.05) AS lo, quantile_cont(score, 0.999) AS hi FROM judged), range(40) r(i)"""


def _spaced_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = judged(spark, sf_dir)
    return evaluate.threshold_sweep(df, "score", "label", evaluate.spaced_thresholds(df, "score", 0.05, 0.999, 40))


@query("threshold_sweep", f"WITH {CTE_JUDGED}, {_sweep_sql(_GRID_VALUES)} SELECT * FROM rates")
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.threshold_sweep(judged(spark, sf_dir), "score", "label", LENGTH_GRID)


@query("threshold_sweep_spaced", f"""WITH {CTE_JUDGED}, {_sweep_sql(_SPACED_VALUES)}
SELECT ordinal, round(threshold, 6) AS threshold, tp, fp, fn, tn, alerts, {_round_sql(RATES)} FROM rates""")
def sweep_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _round(_spaced_sweep(spark, sf_dir), RATES).drop("alert_rate")
    return out.withColumn("threshold", F.round("threshold", 6))


@query("threshold_best_f1", f"""WITH {CTE_JUDGED}, {_sweep_sql(_GRID_VALUES)}
SELECT ordinal, threshold, tp, fp, f1 FROM rates ORDER BY f1 DESC, ordinal LIMIT 1""")
def pick_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_f1(sweep(spark, sf_dir)).select("ordinal", "threshold", "tp", "fp", "f1")


@query("threshold_best_recall", f"""WITH {CTE_JUDGED}, {_sweep_sql(_GRID_VALUES)}
SELECT ordinal, threshold, tp, fp, recall, f1 FROM rates ORDER BY recall DESC, f1 DESC, fp, fn, ordinal LIMIT 1""")
def pick_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_by_recall(sweep(spark, sf_dir)).select("ordinal", "threshold", "tp", "fp", "recall", "f1")


RECALL_TARGETS = [0.5, 0.7, 0.8, 0.9, 0.95, 0.99, 1.0, 1.01]
_TARGETS = ", ".join(f"({t!r}::DOUBLE)" for t in RECALL_TARGETS)
_PER_TARGET = f"""goals AS (SELECT * FROM (VALUES {_TARGETS}) g(target_recall)), per AS (
SELECT target_recall, ordinal, threshold, precision, recall, f1, tp, fp FROM goals LEFT JOIN rates
  ON recall >= target_recall
QUALIFY row_number() OVER (PARTITION BY target_recall ORDER BY precision DESC, f1 DESC, ordinal) = 1)"""


@query("threshold_per_recall_target", f"""WITH {CTE_JUDGED}, {_sweep_sql(_SPACED_VALUES)}, {_PER_TARGET}
SELECT target_recall, ordinal IS NOT NULL AS achieved, round(threshold, 6) AS threshold, round(precision, 8) AS precision,
  round(recall, 8) AS recall, tp::DOUBLE AS tp, fp::DOUBLE AS fp FROM per""")
def per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.best_per_recall_target(_spaced_sweep(spark, sf_dir), RECALL_TARGETS)
    out = _round(out, ["precision", "recall"]).withColumns({
        "threshold": F.round("threshold", 6), "tp": F.col("tp").cast("double"), "fp": F.col("fp").cast("double")})
    return out.select("target_recall", "achieved", "threshold", "precision", "recall", "tp", "fp")


@query("incremental_recall_cost", f"""WITH {CTE_JUDGED}, {_sweep_sql(_SPACED_VALUES)}, {_PER_TARGET}, d AS (
SELECT target_recall, fp - lag(fp) OVER (ORDER BY target_recall) AS dfp, tp - lag(tp) OVER (ORDER BY target_recall) AS dtp
FROM per)
SELECT target_recall, dfp::DOUBLE AS additional_fp, dtp::DOUBLE AS additional_tp,
  round(dfp / nullif(dtp, 0), 8) AS fp_per_additional_tp FROM d""")
def cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.incremental_cost(evaluate.best_per_recall_target(_spaced_sweep(spark, sf_dir), RECALL_TARGETS))
    return out.select("target_recall", F.col("additional_fp").cast("double"), F.col("additional_tp").cast("double"),
                      F.round("fp_per_additional_tp", 8).alias("fp_per_additional_tp"))


@query("thresholds_applied_to_test_split", f"""WITH {CTE_JUDGED}, s AS (
SELECT *, row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(md5('42|' || doc_id::VARCHAR), 1, 13))::BIGINT) - 1
  AS r, count(*) OVER (PARTITION BY label) AS n FROM judged), val AS (
SELECT * FROM s WHERE r >= floor(0.6 * n) AND r < floor(0.8 * n)), tst AS (SELECT * FROM s WHERE r >= floor(0.8 * n)),
cand AS ({' UNION ALL '.join(f"SELECT {i} AS ordinal, quantile_cont(score, {(i + 1) / 10}) AS threshold FROM val" for i in range(9))})
SELECT ordinal, round(threshold, 6) AS threshold, count(*) FILTER (label = 1 AND score >= threshold) AS tp,
  count(*) FILTER (label = 0 AND score >= threshold) AS fp FROM cand, tst GROUP BY ordinal, threshold""")
def applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = splits.stratified_split(judged(spark, sf_dir), "label", "doc_id")
    chosen = evaluate.percentile_thresholds(
        split.where("split = 'validation'"), "score", [(i + 1) / 10 for i in range(9)])
    return evaluate.threshold_sweep(split.where("split = 'test'"), "score", "label", chosen).select(
        "ordinal", F.round("threshold", 6).alias("threshold"), "tp", "fp")


@query("curve_points", f"""WITH {CTE_JUDGED}, v AS (
SELECT score, count(*) AS n, sum(label)::BIGINT AS pos FROM judged GROUP BY score), c AS (
SELECT score, (sum(pos) OVER w)::BIGINT AS tp, (sum(n) OVER w)::BIGINT AS alerts, (sum(pos) OVER ()) AS p,
  (sum(n) OVER ()) AS t FROM v WINDOW w AS (ORDER BY score DESC))
SELECT score AS threshold, tp, alerts - tp AS fp, round(tp / p, 8)::DOUBLE AS tpr,
  round((alerts - tp) / (t - p), 8)::DOUBLE AS fpr, round(tp / alerts, 8)::DOUBLE AS precision FROM c
UNION ALL SELECT NULL, 0, 0, 0, 0, 1""")
def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.curve_points(judged(spark, sf_dir), "score", "label"), ["tpr", "fpr", "precision"])


@query("ranking_metrics", f"""WITH {CTE_JUDGED}, v AS (
SELECT lang, score, count(*) AS n, sum(label)::BIGINT AS pos FROM judged GROUP BY lang, score), c AS (
SELECT *, sum(pos) OVER d AS tp, sum(n) OVER d AS alerts,
  coalesce(sum(n - pos) OVER (PARTITION BY lang ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS neg_below FROM v WINDOW d AS (PARTITION BY lang ORDER BY score DESC)), p AS (
SELECT lang, sum(pos)::DOUBLE AS positives, sum(n - pos)::DOUBLE AS negatives,
  sum(pos * (neg_below + (n - pos) / 2)) AS u, sum(pos * tp / alerts) AS ap FROM c GROUP BY lang)
SELECT lang, round(u / (positives * negatives), 8) AS roc_auc, round(ap / positives, 8) AS pr_auc,
  positives, negatives FROM p""")
def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.ranking_metrics(judged(spark, sf_dir), "score", "label", ["lang"])
    return _round(out, ["roc_auc", "pr_auc"]).withColumns({
        "positives": F.col("positives").cast("double"), "negatives": F.col("negatives").cast("double")})


def _cascade_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.decided(spark, sf_dir).withColumn("first_stage_alert", F.col("alert_required"))


_CASCADE_RATES = ", ".join(
    f"""count(*) FILTER (isFraud = 1 AND {c} = 1) AS {n}_tp, count(*) FILTER (isFraud = 0 AND {c} = 1) AS {n}_fp,
  count(*) FILTER (isFraud = 1 AND {c} = 0) AS {n}_fn, count(*) FILTER (isFraud = 0 AND {c} = 0) AS {n}_tn"""
    for n, c in (("first", "alert_required"), ("cascade", "final_prediction")))


@query("cascade_comparison", f"""WITH {CTE_DECIDED}, c AS (
SELECT {_CASCADE_RATES}, count(*) FILTER (isFraud = 1 AND alert_required = 0 AND final_prediction = 1) AS recovered_fraud
FROM decided)
SELECT *, {', '.join(f"round(coalesce({n}_tp / nullif({n}_tp + {n}_fp, 0), 0), 8)::DOUBLE AS {n}_precision, round(coalesce({n}_tp / nullif({n}_tp + {n}_fn, 0), 0), 8)::DOUBLE AS {n}_recall, round(coalesce(2 * {n}_tp / nullif(2 * {n}_tp + {n}_fp + {n}_fn, 0), 0), 8)::DOUBLE AS {n}_f1, round(coalesce({n}_fp / nullif({n}_fp + {n}_tn, 0), 0), 8)::DOUBLE AS {n}_fpr, {n}_tp + {n}_fp AS {n}_alerts" for n in ("first", "cascade"))},
  first_fn - cascade_fn AS fn_reduction,
  round(coalesce(100.0 * (first_fn - cascade_fn) / nullif(first_fn, 0), 0), 8)::DOUBLE AS fn_reduction_pct FROM c""")
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = [f"{n}_{m}" for n in ("first", "cascade") for m in ("precision", "recall", "f1", "fpr")]
    return _round(evaluate.cascade_comparison(_cascade_rows(spark, sf_dir)), [*rates, "fn_reduction_pct"])


_OUTCOME = """CASE WHEN isFraud = 1 AND alert_required = 1 THEN 'TP' WHEN isFraud = 0 AND alert_required = 1 THEN 'FP'
  WHEN isFraud = 0 THEN 'TN' ELSE 'FN' END"""
_PROFILED = ["amount", "log_amount", "orig_balance_error", *BEHAVIOR_FEATURES]


@query("detected_vs_missed_features", f"""WITH {CTE_DECIDED}, o AS (SELECT *, {_OUTCOME} AS outcome FROM decided), u AS (
{' UNION ALL '.join(f"SELECT outcome, '{c}' AS feature, {c}::DOUBLE AS value FROM o" for c in _PROFILED)})
SELECT outcome, feature, round(avg(value), 5) + 0.0 AS mean, round(quantile_cont(value, 0.5), 5) + 0.0 AS median, count(*) AS n
FROM u WHERE outcome IN ('TP', 'FN') GROUP BY outcome, feature""")
def detected_vs_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.outcome_profile(_cascade_rows(spark, sf_dir), "isFraud", "first_stage_alert", _PROFILED)
    return _round(out, ["mean", "median"], 5)


@query("miss_rate_by_type", f"""WITH {CTE_DECIDED}
SELECT type, count(*) AS fraud, count(*) FILTER (alert_required = 1) AS detected,
  count(*) FILTER (alert_required = 0) AS missed, round(count(*) FILTER (alert_required = 0) / count(*), 8) AS miss_rate
FROM decided WHERE isFraud = 1 GROUP BY type""")
def miss_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.miss_rate_by(_cascade_rows(spark, sf_dir), "type", "isFraud", "first_stage_alert"),
                  ["miss_rate"])


@query("missed_fraud_listing", f"""WITH {CTE_DECIDED}
SELECT event_id, type, amount, anomaly_score FROM decided WHERE isFraud = 1 AND alert_required = 0""")
def missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.outcome_listing(_cascade_rows(spark, sf_dir), "isFraud", "first_stage_alert", "anomaly_score",
                                    "FN", "event_id").select("event_id", "type", "amount", "anomaly_score")


@query("false_positive_listing", f"""WITH {CTE_DECIDED}
SELECT event_id, type, amount, anomaly_score FROM decided WHERE isFraud = 0 AND final_prediction = 1""")
def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.outcome_listing(_cascade_rows(spark, sf_dir), "isFraud", "final_prediction", "anomaly_score",
                                    "FP", "event_id").select("event_id", "type", "amount", "anomaly_score")


@query("top_anomalies", f"""WITH {CTE_DECIDED}
SELECT event_id, anomaly_score, type, amount FROM decided ORDER BY anomaly_score DESC, event_id LIMIT 20""")
def top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.top_anomalies(inputs.scored(spark, sf_dir), "anomaly_score", "event_id").select(
        "event_id", "anomaly_score", "type", "amount")


@query("score_summary_by_class", f"""WITH {CTE_JUDGED}
SELECT label, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, min(score) AS min,
  max(score) AS max, quantile_cont(score, 0.5) AS median FROM judged GROUP BY label""")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.score_summary(judged(spark, sf_dir), "score", "label"), ["mean", "std"], 6)


_SHARES = (0.5, 0.75, 0.9, 0.95, 0.99, 0.995, 0.999)


@query("score_percentiles_by_class", f"""WITH {CTE_JUDGED}, q AS (
{' UNION ALL '.join(f"SELECT label, {s!r}::DOUBLE AS share, quantile_cont(score, {s!r}) AS quantile FROM judged GROUP BY label" for s in _SHARES)})
SELECT label, share, round(quantile, 6) AS quantile FROM q""")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.score_percentiles(judged(spark, sf_dir), "score", "label", _SHARES), ["quantile"], 6)


@query("event_value_percentiles", """WITH q AS (
SELECT event_type, 0.5::DOUBLE AS share, quantile_cont(value, 0.5) AS quantile FROM events GROUP BY event_type
UNION ALL SELECT event_type, 0.95::DOUBLE, quantile_cont(value, 0.95) FROM events GROUP BY event_type)
SELECT event_type, share, round(quantile, 6) AS quantile FROM q""")
def event_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_type", "value")
    return _round(evaluate.score_percentiles(df, "value", "event_type", (0.5, 0.95)), ["quantile"], 6)


@query("score_histogram", f"""WITH {CTE_DECIDED}, b AS (SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM decided)
SELECT isFraud, least(floor((anomaly_score - lo) / ((hi - lo) / 80)), 79)::INT AS bin, count(*) AS n
FROM decided, b GROUP BY ALL""")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.histogram(inputs.scored(spark, sf_dir), "anomaly_score", 80, ["isFraud"])


@query("prediction_shares", f"""WITH {CTE_DECIDED}
SELECT final_prediction, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8)::DOUBLE AS share
FROM decided GROUP BY final_prediction""")
def prediction_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.shares_of(inputs.decided(spark, sf_dir), "final_prediction"), ["share"])


@query("tier_summary", f"""WITH {CTE_DECIDED}
SELECT risk_level, count(*) AS records, count(*) FILTER (isFraud = 1) AS anomalies,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS population_pct,
  round(100.0 * count(*) FILTER (isFraud = 1) / count(*), 6)::DOUBLE AS purity_pct FROM decided GROUP BY risk_level""")
def tier_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.tier_summary(assign_tiers(inputs.scored(spark, sf_dir))), ["population_pct", "purity_pct"], 6)


@query("chronological_split", f"""WITH {CTE_TX}, s AS (
SELECT event_id, row_number() OVER (ORDER BY step, amount, event_id) - 1 AS r, count(*) OVER () AS n FROM valid)
SELECT event_id, CASE WHEN r < floor(0.6 * n) THEN 'train' WHEN r < floor(0.8 * n) THEN 'validation' ELSE 'test' END
  AS split FROM s""")
def chronological(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.chronological_split(inputs.valid_transactions(spark, sf_dir)).select("event_id", "split")


def _hash_sql(key: str, seed: int) -> str:
    return f"('0x' || substr(md5('{seed}|' || {key}::VARCHAR), 1, 13))::BIGINT"


@query("stratified_split", f"""WITH {CTE_TX}, s AS (
SELECT event_id, isFraud, row_number() OVER (PARTITION BY isFraud ORDER BY {_hash_sql('event_id', 42)}) - 1 AS r,
  count(*) OVER (PARTITION BY isFraud) AS n FROM valid)
SELECT event_id, isFraud, CASE WHEN r < floor(0.6 * n) THEN 'train' WHEN r < floor(0.8 * n) THEN 'validation'
  ELSE 'test' END AS split FROM s""")
def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(inputs.valid_transactions(spark, sf_dir), "isFraud", "event_id").select(
        "event_id", "isFraud", "split")


@query("seeded_sample", f"SELECT event_id, user_id FROM events ORDER BY {_hash_sql('event_id', 7)}, event_id LIMIT 500")
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.seeded_sample(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 500, seed=7)


@query("class_weight", f"""WITH {CTE_TX}
SELECT count(*) FILTER (isFraud = 1) AS positives, count(*) FILTER (isFraud = 0) AS negatives,
  round(count(*) FILTER (isFraud = 0) / greatest(count(*) FILTER (isFraud = 1), 1), 8) AS weight FROM valid""")
def weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.class_weight(inputs.valid_transactions(spark, sf_dir), "isFraud"), ["weight"])


@query("model_comparison", f"""WITH {CTE_DECIDED}, m AS (
SELECT 'first_stage' AS model, count(*) FILTER (isFraud = 1 AND alert_required = 1) AS tp,
  count(*) FILTER (alert_required = 1) AS said, count(*) FILTER (isFraud = 1) AS pos FROM decided
UNION ALL SELECT 'cascade', count(*) FILTER (isFraud = 1 AND final_prediction = 1),
  count(*) FILTER (final_prediction = 1), count(*) FILTER (isFraud = 1) FROM decided), l AS (
SELECT model, 'precision' AS metric, tp / said AS value FROM m UNION ALL SELECT model, 'recall', tp / pos FROM m
UNION ALL SELECT model, 'f1', 2 * tp / (said + pos) FROM m)
SELECT metric, round(max(value) FILTER (model = 'first_stage'), 8) AS first_stage,
  round(max(value) FILTER (model = 'cascade'), 8) AS cascade FROM l GROUP BY metric""")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _cascade_rows(spark, sf_dir).select("isFraud", F.inline(F.array(
        F.struct(F.lit("first_stage").alias("model"), F.col("first_stage_alert").alias("said")),
        F.struct(F.lit("cascade").alias("model"), F.col("final_prediction").alias("said")))))
    rates = evaluate.confusion(said, "isFraud", "said", ["model"])
    long = rates.select("model", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("precision", "recall", "f1")])))
    return _round(evaluate.compare_models(long, ["first_stage", "cascade"]), ["first_stage", "cascade"])


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_TEXT = ["l_returnflag", "l_linestatus"]


@query("column_audit", "WITH a AS (" + " UNION ALL ".join(
    [f"SELECT '{c}' AS column_name, 'double' AS type, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_values, "
     f"round(avg({c}), 4) AS mean, round(stddev({c}), 4) AS std, min({c}) AS min, max({c}) AS max FROM lineitem" for c in _NUMERIC]
    + [f"SELECT '{c}', 'string', count(*) - count({c}), count(DISTINCT {c}), NULL, NULL, NULL, NULL FROM lineitem" for c in _TEXT])
    + ") SELECT *, 0.0::DOUBLE AS missing_pct FROM a")
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(profile.column_audit(table(spark, sf_dir, "lineitem").select(*_NUMERIC, *_TEXT)), ["mean", "std"], 4)


@query("duplicate_rows", """SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT text FROM documents)) AS distinct_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT text FROM documents)) AS duplicate_rows FROM documents""")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_rows(table(spark, sf_dir, "documents").select("text"))


@query("describe_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, count(*) FILTER ({c} IS NULL) AS missing, round(avg({c}), 4) AS mean, "
    f"round(stddev({c}), 4) AS std, round(variance({c}), 2) AS variance, min({c}) AS min, max({c}) AS max, "
    f"round(quantile_cont({c}, 0.5), 6) AS median FROM lineitem" for c in _NUMERIC))
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.describe_columns(table(spark, sf_dir, "lineitem"), _NUMERIC)
    return _round(_round(_round(out, ["mean", "std"], 4), ["variance"], 2), ["median"], 6)


_CORRELATED = ["amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest", "orig_balance_change",
               "dest_balance_change", "orig_balance_error", "dest_balance_error", "log_amount", "orig_zero_after",
               "isFraud"]


@query("correlation_matrix", f"WITH {CTE_BASE} " + " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", " + ("1.0::DOUBLE" if a == b else f"round(corr({a}, {b}), 6) + 0.0")
    + " AS correlation FROM " + ("(SELECT 1)" if a == b else "base") for a in _CORRELATED for b in _CORRELATED))
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywatch.operators.features import base_features

    df = base_features(inputs.valid_transactions(spark, sf_dir))
    return _round(profile.correlation_matrix(df, _CORRELATED), ["correlation"], 6)


@query("category_counts", f"""WITH {CTE_TX}
SELECT type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS pct FROM valid GROUP BY type""")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(profile.category_counts(inputs.valid_transactions(spark, sf_dir), "type"), ["pct"], 6)


_FLAGS = ["type_CASH_IN", "type_CASH_OUT", "type_DEBIT", "type_PAYMENT", "type_TRANSFER", "orig_zero_after"]


@query("active_flags", f"WITH {CTE_BASE} " + " UNION ALL ".join(
    f"SELECT '{f}' AS flag, count(*) FILTER (\"{f}\" = 1) AS active_rows, "
    f"round(count(*) FILTER (\"{f}\" = 1) * 100.0 / count(*), 6)::DOUBLE AS pct FROM base" for f in _FLAGS))
def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywatch.operators.features import base_features

    return _round(profile.active_flags(base_features(inputs.valid_transactions(spark, sf_dir)), _FLAGS), ["pct"], 6)


@query("class_balance", """SELECT count(*) AS rows, count(*) FILTER (toxic = 1) AS positives,
  round(count(*) FILTER (toxic = 1) * 100.0 / count(*), 6)::DOUBLE AS positive_pct,
  round(count(*) FILTER (toxic = 0) / greatest(count(*) FILTER (toxic = 1), 1), 6)::DOUBLE AS imbalance_ratio FROM labels""")
def balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(profile.class_balance(table(spark, sf_dir, "labels"), "toxic"), ["positive_pct", "imbalance_ratio"], 6)
