"""Queries: checks over result documents and generated answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywatch.operators import quality
from tallywatch.plans.registry import query, table

# Documents become result payloads; every remainder plants another defect.
_BODY = """concat('{"investigation_summary": ', CASE WHEN doc_id % 12 = 1 THEN '"  "' WHEN doc_id % 12 = 2 THEN '7' ELSE '"A summary of the case"' END,
  CASE WHEN doc_id % 12 = 3 THEN ', "extra_field": 1' ELSE '' END,
  CASE WHEN doc_id % 12 = 4 THEN '' ELSE ', "uncertainties": ["u1"]' END,
  ', "risk_factors": ', CASE WHEN doc_id % 12 = 5 THEN '["a", 3]' WHEN doc_id % 12 = 6 THEN '"text"' ELSE '["a"]' END,
  ', "counter_evidence": [], "missing_evidence": [], "recommended_review_points": [], "historical_comparison": ',
  CASE WHEN doc_id % 12 = 7 THEN '{"fraud_cases": []}' WHEN doc_id % 12 = 8 THEN '{"fraud_cases": [{"source_id": "x"}], "normal_cases": []}'
    ELSE '{"fraud_cases": [{"source_id": "x", "comparison": "y"}], "normal_cases": []}' END, ', "evidence": [{"source_type": "',
  CASE WHEN doc_id % 12 = 9 THEN 'rumour' ELSE 'model_output' END, '", "source_id": "d', doc_id, '", "finding": "f"}]',
  ', "regulatory_references": ', CASE WHEN doc_id % 12 = 10 THEN '[{"source_id": "r"}]' ELSE '[]' END, '}')"""
_JSON = f"CASE WHEN doc_id % 12 = 11 THEN 'not json' ELSE {_BODY} END"


@query("payload_violations", f"""WITH j AS (SELECT doc_id, {_JSON} AS t FROM documents), v AS (
SELECT doc_id, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM j)
SELECT doc_id, concat_ws(',', CASE WHEN j IS NULL THEN 'root' END,
  CASE WHEN len(list_filter(json_keys(j), lambda k: k NOT IN ('investigation_summary', 'evidence', 'risk_factors', 'counter_evidence',
    'missing_evidence', 'historical_comparison', 'regulatory_references', 'uncertainties', 'recommended_review_points'))) > 0
    THEN 'unsupported_key' END,
  CASE WHEN j IS NOT NULL AND json_type(j, '$.uncertainties') IS NULL THEN 'missing:uncertainties' END,
  CASE WHEN json_type(j, '$.investigation_summary') <> 'VARCHAR' OR trim(j->>'$.investigation_summary') = ''
    THEN 'invalid:investigation_summary' END,
  CASE WHEN json_type(j, '$.risk_factors') <> 'ARRAY' THEN 'not_array:risk_factors' END,
  CASE WHEN json_type(j, '$.risk_factors') = 'ARRAY' AND len(list_filter(json_extract(j, '$.risk_factors[*]'),
    lambda x: json_type(x) <> 'VARCHAR')) > 0 THEN 'not_strings:risk_factors' END,
  CASE WHEN j IS NOT NULL AND (json_type(j, '$.historical_comparison.fraud_cases') IS NULL
    OR json_type(j, '$.historical_comparison.normal_cases') IS NULL) THEN 'invalid:historical_comparison' END,
  CASE WHEN len(list_filter(json_extract(j, '$.historical_comparison.fraud_cases[*]'),
    lambda x: json_type(x, '$.comparison') IS NULL)) > 0 THEN 'invalid:historical_comparison.fraud_cases' END,
  CASE WHEN len(list_filter(json_extract(j, '$.evidence[*]'), lambda x: (x->>'$.source_type') NOT IN ('live_transaction',
    'cassandra_history', 'model_output', 'rbi_knowledge', 'paysim_fraud', 'paysim_normal', 'missing_evidence'))) > 0
    THEN 'invalid:evidence' END,
  CASE WHEN len(list_filter(json_extract(j, '$.regulatory_references[*]'), lambda x: json_type(x, '$.reference') IS NULL)) > 0
    THEN 'invalid:regulatory_references' END) AS violations FROM v""")
def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents", heavy=True).select("doc_id", F.expr(_JSON).alias("payload"))
    return quality.check_payloads(df, "payload").select("doc_id", F.array_join("violations", ",").alias("violations"))


_RESULT = f"""concat(substr({_BODY}, 1, length({_BODY}) - 1), ', "alert_assessment": {{"risk_level": "L3", "model_prediction": 1, ',
  '"anomaly_score": 0.1, "xgboost_probability": null', CASE WHEN doc_id % 5 = 1 THEN '' ELSE ', "decision_path": "p"' END,
  '}}, "investigation_id": "i", "alert_id": "a", "transaction_id": "t", "generated_at": "2024-01-01T00:00:00Z", "investigation_status": "',
  CASE WHEN doc_id % 5 = 2 THEN 'open' ELSE 'completed' END, '"', CASE WHEN doc_id % 5 = 3 THEN '' ELSE ', "llm_model": "m"' END,
  ', "rag_version": "1"}}')"""


@query("result_violations", f"""WITH v AS (SELECT doc_id, {_RESULT}::JSON AS j FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN json_type(j, '$.extra_field') IS NOT NULL THEN 'unsupported_key' END,
  CASE WHEN json_type(j, '$.uncertainties') IS NULL THEN 'missing:uncertainties' END,
  CASE WHEN json_type(j, '$.llm_model') IS NULL THEN 'missing:llm_model' END,
  CASE WHEN json_type(j, '$.investigation_summary') <> 'VARCHAR' OR trim(j->>'$.investigation_summary') = ''
    THEN 'invalid:investigation_summary' END,
  CASE WHEN json_type(j, '$.risk_factors') <> 'ARRAY' THEN 'not_array:risk_factors' END,
  CASE WHEN json_type(j, '$.risk_factors') = 'ARRAY' AND len(list_filter(json_extract(j, '$.risk_factors[*]'),
    lambda x: json_type(x) <> 'VARCHAR')) > 0 THEN 'not_strings:risk_factors' END,
  CASE WHEN json_type(j, '$.historical_comparison.normal_cases') IS NULL THEN 'invalid:historical_comparison' END,
  CASE WHEN len(list_filter(json_extract(j, '$.historical_comparison.fraud_cases[*]'),
    lambda x: json_type(x, '$.comparison') IS NULL)) > 0 THEN 'invalid:historical_comparison.fraud_cases' END,
  CASE WHEN (j->>'$.evidence[0].source_type') <> 'model_output' THEN 'invalid:evidence' END,
  CASE WHEN json_array_length(j, '$.regulatory_references') > 0 THEN 'invalid:regulatory_references' END,
  CASE WHEN (j->>'$.investigation_status') NOT IN ('completed', 'partial', 'insufficient_evidence', 'failed')
    THEN 'invalid:investigation_status' END,
  CASE WHEN json_type(j, '$.alert_assessment.decision_path') IS NULL THEN 'invalid:alert_assessment' END) AS violations FROM v""")
def result(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents", heavy=True).select("doc_id", F.expr(_RESULT).alias("payload"))
    return quality.check_results(df, "payload").select("doc_id", F.array_join("violations", ",").alias("violations"))


# Whole documents with a claim in front of them.
_CLAIM = """concat(CASE doc_id % 8 WHEN 0 THEN 'The PaySim similarity confirms that this is fraud. ' WHEN 1 THEN 'No previous alerts exist. '
  WHEN 2 THEN 'The customer occupation is trader. ' WHEN 3 THEN 'A historical case had a risk level of L4. '
  WHEN 4 THEN 'The RBI says a balance decrease is a fraud indicator. ' WHEN 5 THEN 'Fraud was established by the model. '
  WHEN 6 THEN 'The historical transaction shows an amount. ' ELSE '' END, text)"""
_SOURCES = "CASE WHEN doc_id % 16 = 2 THEN 'occupation: trader' ELSE 'amount 10' END"
_UNSAFE_SQL = quality.UNSAFE_CLAIM.replace("'", "''")
_REGULATOR_SQL = quality.REGULATOR_CLAIM.replace("'", "''")
_TERMS_SQL = " OR ".join(f"(f LIKE '%{t}%' AND src NOT LIKE '%{t}%')" for t in quality.CUSTOMER_TERMS)


@query("claim_flags", f"""WITH c AS (SELECT doc_id, {_CLAIM} AS t, lower({_CLAIM}) AS f, {_SOURCES} AS src FROM documents)
SELECT doc_id, regexp_matches(t, '{_UNSAFE_SQL}') AS proof_claim, ({_TERMS_SQL}) AS customer_claim,
  regexp_matches(t, '(?i)paysim|historical case|historical transaction')
    AND regexp_matches(t, '(?i)anomaly[_ ]score|xgboost[_ ]probability|risk[_ ]level|final[_ ]prediction|decision[_ ]path') AS model_leak,
  regexp_matches(t, '{_REGULATOR_SQL}') AND NOT (regexp_matches(src, '(?i)balance|origin|destination')) AS regulator_claim FROM c""")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents", heavy=True).select("doc_id", F.expr(_CLAIM).alias("t"), F.expr(_SOURCES).alias("src"))
    flags = quality.claim_flags(F.col("t"), F.col("src"), F.array(F.lit("amount"), F.lit("type")), F.lit("EWS and RFA text"))
    return df.select("doc_id", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()])


@query("guarded_claims", f"""WITH c AS (SELECT doc_id, doc_id % 8 AS k, {_CLAIM} AS t, {_SOURCES} AS src FROM documents), s AS (
SELECT *, regexp_replace(t, 'no previous alerts exist', 'no previous alerts were retrieved', 'gi') AS soft FROM c), a AS (
SELECT *, CASE WHEN regexp_matches(soft, '{_UNSAFE_SQL}') THEN '{quality.WITHHELD_PROOF}' ELSE soft END AS t1 FROM s), b AS (
SELECT *, CASE WHEN regexp_matches(t1, '(?i)paysim|historical case|historical transaction') AND regexp_matches(t1,
  '(?i)anomaly[_ ]score|xgboost[_ ]probability|risk[_ ]level|final[_ ]prediction|decision[_ ]path')
  THEN '{quality.WITHHELD_LEAK}' ELSE t1 END AS t2 FROM a), d AS (
SELECT *, CASE WHEN regexp_matches(t2, '{_REGULATOR_SQL}') THEN '{quality.WITHHELD_REGULATOR}' ELSE t2 END AS t3 FROM b), e AS (
SELECT *, lower(t3) AS f FROM d)
SELECT doc_id, md5(CASE WHEN {_TERMS_SQL} THEN '{quality.WITHHELD_CUSTOMER}' ELSE t3 END) AS guarded_md5 FROM e""")
def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents", heavy=True).select("doc_id", F.expr(_CLAIM).alias("t"), F.expr(_SOURCES).alias("src"))
    text = quality.guarded_claim(F.col("t"), F.col("src"), F.array(F.lit("amount"), F.lit("type")), F.lit("EWS and RFA text"))
    return df.select("doc_id", F.md5(text).alias("guarded_md5"))


_ANSWER = """concat(CASE turn % 5 WHEN 0 THEN 'He works as a clerk. ' WHEN 1 THEN 'The IP address is 10.0.0.1 . '
  WHEN 2 THEN 'History is not available. ' WHEN 3 THEN 'This proves fraud. ' ELSE '' END, text)"""
_STOP_SQL = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
_ABSENT_SQL = " OR ".join(f"lower(answer) LIKE '%{p}%'" for p in quality.ABSENCE_PHRASES)


@query("answer_heuristics", f"""WITH c AS (SELECT conv_id, turn, 'Is the customer account de la unusual and why' AS question, {_ANSWER} AS answer
FROM conversations), k AS (
SELECT *, list_filter(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')), lambda w: w NOT IN ({_STOP_SQL})) AS q,
  list_filter(list_distinct(regexp_extract_all(lower(answer), '[a-z0-9]+')), lambda w: w NOT IN ({_STOP_SQL})) AS a FROM c)
SELECT conv_id, turn, round(len(list_intersect(q, a)) / greatest(len(q), 1), 4) AS relevance_keyword_overlap,
  CASE WHEN turn % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS source_attribution_completeness,
  CASE WHEN turn % 3 = 0 THEN NULL ELSE (({_ABSENT_SQL})::INT)::DOUBLE END AS missing_evidence_acknowledged,
  concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(answer, '{p}') THEN '{n}' END" for n, p in quality.ANSWER_FLAGS.items())})
    AS unsupported_claim_flags FROM k""")
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.struct(F.lit("s").alias("source_id"), F.lit("model_output").alias("source_type"))
    blank = F.struct(F.lit("").alias("source_id"), F.lit("model_output").alias("source_type"))
    df = table(spark, sf_dir, "conversations", heavy=True).select(
        "conv_id", "turn", F.lit("Is the customer account de la unusual and why").alias("question"),
        F.expr(_ANSWER).alias("answer"), F.lit("").alias("evidence_text"),
        F.when(F.col("turn") % 2 == 0, F.array(source, blank)).otherwise(F.array(source)).alias("cited"),
        F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("none"))).alias("missing"))
    return quality.assess_answers(df).select(
        "conv_id", "turn", "relevance_keyword_overlap", "source_attribution_completeness",
        "missing_evidence_acknowledged", F.array_join("unsupported_claim_flags", ",").alias("unsupported_claim_flags"))


_NUMBERS = "concat('Found ', doc_id, ' items, +', n_chars, ' chars and -', doc_id % 7, '.25 points in v', n_chars, 'x')"
_KNOWN = "concat('items=', doc_id, CASE WHEN n_chars % 2 = 0 THEN concat('; chars=', n_chars) ELSE '' END)"


@query("numeric_grounding", """WITH c AS (SELECT doc_id, list_distinct([doc_id::VARCHAR, n_chars::VARCHAR,
  concat('-', doc_id % 7, '.25')]) AS said, CASE WHEN n_chars % 2 = 0 THEN [doc_id::VARCHAR, n_chars::VARCHAR]
  ELSE [doc_id::VARCHAR] END AS known FROM documents)
SELECT doc_id, round(len(list_intersect(said, known)) / len(said), 4) AS numeric_grounding_fraction FROM c""")
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("q").alias("question"), F.expr(_NUMBERS).alias("answer"), F.expr(_KNOWN).alias("evidence_text"),
        F.array().cast("array<struct<source_id:string,source_type:string>>").alias("cited"),
        F.array().cast("array<string>").alias("missing"))
    return quality.assess_answers(df).select("doc_id", "numeric_grounding_fraction")
